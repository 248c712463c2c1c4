"""Sets of hashed word shingles of whole texts, computed for many texts at once with numpy.

Words are the runs between the bytes [\\x20\\x09-\\x0D], A-Z lower-cased. A text with fewer words than a
shingle has its whole sequence as its one shingle; a null, empty or blank text has no shingle.
Hashes have 64 bits: two different shingles among n meet with probability about n*n/2**65.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(19, (n - 1).bit_length()))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and where each text's words begin (one more entry than texts)."""
    joined = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if not len(joined):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    within = ~_SPACE[joined]
    edge = np.diff(within.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(joined) + 1)
    total = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((_FOLD[joined].astype(np.uint64) + np.uint64(1)) * up[: len(joined)], out=total[1:])
    h = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return h, np.searchsorted(start, offsets)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    h, at = word_hashes(texts)
    weights = [np.uint64((_BASE * (2 * i + 3)) & _MASK) for i in range(words)]
    n = max(0, len(h) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for i, w in enumerate(weights):
        rolled += h[i : i + n] * w
    rolled = mixed(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            short = (h[a:b] * np.array(weights[: b - a], np.uint64)).sum(keepdims=True, dtype=np.uint64) + np.array([b - a], np.uint64)
            out.append(mixed(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
