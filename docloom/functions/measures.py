"""Distances between texts, words and tables."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Whole numbers of 64 bits that one step of many distances works on, and the least for which that beats whole numbers of Python.
WIDE, LEAST = 8192, 512
#: Bytes of a pair's table of places beyond which it is left to whole numbers of Python.
TABLE = 1 << 20


def _pair(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The longer and the shorter array without the head and the tail that they share, their symbols numbered in the longer one, and how many it has: the number of what stands in the shorter one alone."""
    n = min(len(a), len(b))
    same = np.append(a[:n] == b[:n], False)
    head = int(np.argmin(same))
    a, b, n = a[head:], b[head:], n - head
    same = np.append(a[::-1][:n] == b[::-1][:n], False)
    tail = int(np.argmin(same))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    longer, shorter = (a, b) if len(a) >= len(b) else (b, a)
    if not len(shorter):
        return longer, shorter, 0
    if max(longer.max(), shorter.max()) > 1 << 16:
        both = np.unique(np.concatenate([longer, shorter]), return_inverse=True)[1]
        longer, shorter = both[: len(longer)], both[len(longer) :]
    there = np.zeros(int(max(longer.max(), shorter.max())) + 1, bool)
    there[longer] = True
    number = np.cumsum(there) - 1
    symbols = int(number[-1]) + 1
    number[~there] = symbols
    return number[longer], number[shorter], symbols


def _places(longer: np.ndarray, symbols: int) -> list[int]:
    """For each symbol the bits of the places that hold it, from bit 1; for the number behind them none."""
    order = np.argsort(longer, kind="stable")
    at, bounds = (order + 1).tolist(), np.searchsorted(longer[order], np.arange(symbols + 1)).tolist()
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a < 16:
            out.append(sum([1 << i for i in at[a:b]]))
            continue
        held = np.zeros(len(longer) + 1, bool)
        held[order[a:b] + 1] = True
        out.append(int.from_bytes(np.packbits(held, bitorder="little").tobytes(), "little"))
    return [*out, 0]


def _one_distance(longer: np.ndarray, shorter: np.ndarray, symbols: int) -> int:
    """Edit distance: differences of neighbouring cells of a column are bits of whole numbers, so a step of the shorter array takes a few operations on them.

    Bit 0 is the row above the first, whose cells grow by one. What carries run beyond the last bit never comes back down, and is cut off now and then.
    """
    at, cells = _places(longer, symbols), (2 << len(longer)) - 1
    own = cells - 1
    up, down = own, 0  # cells that are one more, and one less, than the cell above
    for a in range(0, len(shorter), 64):
        for symbol in shorter[a : a + 64].tolist():
            equal = at[symbol] | down
            diagonal = ((equal & up) + up ^ up) | equal
            right = (down | cells ^ (up | diagonal)) << 1
            up = (up & diagonal) << 1 | own ^ (right | diagonal)
            down = right & diagonal
        up &= cells
        down &= cells
    return len(shorter) + up.bit_count() - down.bit_count()


def _wave(pairs: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Distances of pairs, all at once: columns are cut into blocks of 64 cells, the blocks of all pairs lie in one row, and block b of a column is worked on b steps after its first one, when what comes down from the block above is known.

    Before a block begins no cell is equal and nothing comes from above, which leaves its column as it is; when it ends its column is put down.
    """
    long, short = np.array([len(x) for x, _, _ in pairs]), np.array([len(y) for _, y, _ in pairs])
    blocks = -(-long // 64)
    first = np.concatenate([[0], np.cumsum(blocks)])
    total, first = int(first[-1]), first[:-1]
    steps = int((blocks + short).max()) - 1
    # the places of each pair's symbols as bits, a row of blocks for each and one for what stands nowhere
    size = blocks * np.array([n + 1 for _, _, n in pairs])
    base = np.cumsum(size) - size
    nowhere = base + size - blocks
    begins, comes = np.repeat(nowhere[:, None], steps, axis=1), np.zeros((len(pairs), steps), np.uint64)
    table = np.zeros(int(size.sum()), np.uint64)
    for k, ((longer, shorter, _), n, start) in enumerate(zip(pairs, blocks.tolist(), base.tolist(), strict=True)):
        place = np.arange(len(longer))
        np.add.at(table, start + longer * n + (place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        begins[k, : len(shorter)] = start + shorter * n
        comes[k, : len(shorter)] = 1
    begins, comes = np.ascontiguousarray(begins.T), np.ascontiguousarray(comes.T)
    u, d, e, f, g, r, w, more, less = (np.zeros(total, np.uint64) for _ in range(9))
    np.invert(u, out=u)  # u, d: cells that are one more, and one less, than the cell above
    block = np.arange(total) - np.repeat(first, blocks)
    at, later = np.repeat(nowhere, blocks) + block, np.zeros(total, np.intp)
    ends = block + np.repeat(short, blocks) - 1
    ended = np.argsort(ends, kind="stable")
    cuts = np.searchsorted(ends[ended], np.arange(steps + 1)).tolist()
    grew, fell = np.zeros(total, np.uint64), np.zeros(total, np.uint64)
    one, last = np.uint64(1), np.uint64(63)
    for step in range(steps):
        at[first] = begins[step]
        more[first], less[first] = comes[step], 0
        table.take(at, out=e, mode="clip")
        np.add(at[:-1], 1, out=later[1:])
        at, later = later, at
        np.bitwise_or(e, d, out=f)
        np.bitwise_or(e, less, out=e)
        np.bitwise_and(e, u, out=g)
        np.add(g, u, out=g)
        np.bitwise_xor(g, u, out=g)
        np.bitwise_or(g, e, out=g)
        np.bitwise_or(g, d, out=g)
        np.bitwise_or(g, u, out=r)
        np.invert(r, out=r)
        np.bitwise_or(r, d, out=r)
        np.bitwise_and(u, g, out=w)
        np.left_shift(r, one, out=u)
        np.bitwise_or(u, more, out=u)
        np.left_shift(w, one, out=g)
        np.bitwise_or(g, less, out=g)
        np.right_shift(r[:-1], last, out=more[1:])
        np.right_shift(w[:-1], last, out=less[1:])
        np.bitwise_and(u, f, out=d)
        np.bitwise_or(u, f, out=u)
        np.invert(u, out=u)
        np.bitwise_or(u, g, out=u)
        if cuts[step] < cuts[step + 1]:
            now = ended[cuts[step] : cuts[step + 1]]
            grew[now], fell[now] = u[now], d[now]
    own = np.repeat(long, blocks) - 64 * block
    live = np.where(own >= 64, ~np.uint64(0), (one << np.minimum(own, 63).astype(np.uint64)) - one)
    grown = np.bitwise_count(grew & live).astype(np.int64) - np.bitwise_count(fell & live)
    return short + np.add.reduceat(grown, first)


def code_distances(pairs: Iterable[tuple[np.ndarray, np.ndarray] | None]) -> list[int | None]:
    """Edit distance of each pair of arrays of numbers; pairs of about as many steps are worked on together. None gives None."""
    out: list[int | None] = []
    left: list[tuple[int, int, int, tuple[np.ndarray, np.ndarray, int]]] = []
    for pair in pairs:
        its = None if pair is None else _pair(*pair)
        out.append(None if its is None else len(its[0]))
        if its is not None and len(its[1]):
            blocks = -(-len(its[0]) // 64)
            left.append((blocks + len(its[1]), blocks, len(out) - 1, its))
    left.sort(key=lambda x: x[:3])
    group: list[tuple[int, tuple[np.ndarray, np.ndarray, int]]] = []
    wide = least = 0

    def close() -> None:
        together = wide >= LEAST
        found = _wave([x for _, x in group]).tolist() if together else [_one_distance(*x) for _, x in group]
        for (at, _), n in zip(group, found, strict=True):
            out[at] = n
        group.clear()

    for steps, blocks, at, its in left:
        if 8 * blocks * (1 + its[2]) > TABLE:
            out[at] = _one_distance(*its)
            continue
        if group and (wide + blocks > WIDE or steps > 64 + 1.25 * least):
            close()
        if not group:
            wide, least = 0, steps
        group.append((at, its))
        wide += blocks
    close()
    return out


def code_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance of two arrays of numbers."""
    longer, shorter, symbols = _pair(a, b)
    return _one_distance(longer, shorter, symbols) if len(shorter) else len(longer)


def _numbered(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    """Both lists with the same number for the same thing."""
    number: dict = {}
    first, second = (np.fromiter((number.setdefault(x, len(number)) for x in xs), np.int64, len(xs)) for xs in (a, b))
    return first, second


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def sequence_distance(a: list, b: list) -> int:
    """Edit distance of two lists of anything that can be a key."""
    return code_distance(*_numbered(a, b))


def string_distance(a: str, b: str) -> int:
    return code_distance(_codes(a), _codes(b))


@F.pandas_udf(T.IntegerType())
def list_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance of two arrays of strings, such as words."""
    return pd.Series(code_distances(None if x is None or y is None else _numbered(list(x), list(y)) for x, y in zip(a, b, strict=True)), dtype="Int32")


@F.pandas_udf(T.IntegerType())
def long_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance of two long texts."""
    return pd.Series(code_distances(None if x is None or y is None else (_codes(x), _codes(y)) for x, y in zip(a, b, strict=True)), dtype="Int32")


#: The white space of Unicode, which differs from Python's in four control characters.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_CONTROLS = re.compile("[\x1c-\x1f]")


def words_of(text: str) -> list[str]:
    return [w for w in _BLANKS.split(text) if w] if _CONTROLS.search(text) else text.split()


@F.pandas_udf(T.StructType([T.StructField("distance", T.IntegerType()), T.StructField("size", T.IntegerType())]))
def word_distance(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Edit distance of two texts in words, and the words of the first."""
    sizes: list[int | None] = []

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        for x, y in zip(a, b, strict=True):
            first = None if x is None else words_of(x)
            sizes.append(None if first is None else len(first))
            yield None if first is None or y is None else _numbered(first, words_of(y))

    return pd.DataFrame({"distance": pd.Series(code_distances(pairs()), dtype="Int32"), "size": pd.Series(sizes, dtype="Int32")})


_TOKEN = re.compile("[0-9a-z]+")


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("overlap", "n_reference", "n_candidate")]))
def token_overlap(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Tokens that two lower-cased texts share, as often as both hold them, and the tokens of each; null texts give nulls."""
    rows = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            rows.append((None, None, None))
            continue
        first, second = _TOKEN.findall(x), _TOKEN.findall(y)
        rows.append(((Counter(first) & Counter(second)).total(), len(first), len(second)))
    return pd.DataFrame(rows, columns=["overlap", "n_reference", "n_candidate"], dtype="Int64")


#: Cells up to which the built-in distance is the faster one.
CELLS = 100_000


def text_distance(a: Column, b: Column) -> Column:
    """Edit distance of two texts of any length: the built-in function on short ones, bits of whole numbers on long ones."""
    cells = F.length(a).cast("long") * F.length(b)
    return F.when(cells <= CELLS, F.levenshtein(a, b)).otherwise(long_distance(F.when(cells > CELLS, a), F.when(cells > CELLS, b)))


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over all characters, by longest matching blocks."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def error_rate(distance: Column, reference: Column) -> Column:
    """Null where the reference is empty."""
    return F.try_divide(distance.cast("double"), reference.cast("double"))


def character_errors(reference: Column, given: Column) -> Column:
    """Edit distance over the reference's length; blanks don't count."""
    a, b = (F.regexp_replace(x, r"(?U)\s+", "") for x in (reference, given))
    return error_rate(text_distance(a, b), F.length(a))


def normalized_distance(reference: Column, given: Column) -> Column:
    a, b = (F.regexp_replace(x, r"(?U)\s+", "") for x in (reference, given))
    return error_rate(text_distance(a, b), F.greatest(F.length(a), F.length(b)))


def with_distance(pairs: DataFrame, reference: str, given: str) -> DataFrame:
    """pairs with ``distance``, ``reference_size`` and ``given_size``, blanks left out: what all rates of characters are made of, computed once."""
    dense = pairs.withColumns({c: F.regexp_replace(c, r"(?U)\s+", "") for c in (reference, given)})
    told = dense.withColumn("distance", text_distance(F.col(reference), F.col(given)))
    return told.withColumns({"reference_size": F.length(reference), "given_size": F.length(given)})


def word_errors(reference: Column, given: Column) -> Column:
    told = word_distance(reference, given)
    return error_rate(told["distance"], told["size"])


def table_content(reference: Column, candidate: Column) -> Column:
    """1 less the normalised edit distance of all cells of two arrays of rows, blanks dropped."""
    a, b = (F.regexp_replace(F.array_join(F.flatten(t), " "), r"(?U)\s+", "") for t in (reference, candidate))
    return F.greatest(F.lit(0.0), 1 - text_distance(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def table_structure(reference: Column, candidate: Column) -> Column:
    """Mean of the agreement in rows and in cells of paired rows; an unpaired row counts as the widest."""
    n, m = F.size(reference), F.size(candidate)
    wide = lambda t: F.coalesce(F.array_max(F.transform(t, F.size)), F.lit(0))
    rows, columns = F.greatest(n, m, F.lit(1)), F.greatest(wide(reference), wide(candidate), F.lit(1))
    apart = F.aggregate(F.zip_with(F.slice(reference, 1, F.least(n, m)), F.slice(candidate, 1, F.least(n, m)), lambda x, y: F.abs(F.size(x) - F.size(y))), F.lit(0), lambda s, x: s + x)
    row_score = 1 - F.abs(n - m) / rows
    column_score = 1 - (apart + F.abs(n - m) * columns) / (rows * columns)
    return F.greatest(F.lit(0.0), (row_score + column_score) / 2)


def _ordered(rows: list[list[str]]) -> list[tuple[str, str, int]]:
    """(kind, text, leftmost leaf) of a table's tree, children before parents."""
    out: list[tuple[str, str, int]] = []
    for row in rows:
        left = len(out)
        out.extend(("td", cell, left + i) for i, cell in enumerate(row))
        out.append(("tr", "", left))
    return [*out, ("table", "", 0)]


def table_tree_distance(a: list[list[str]], b: list[list[str]], contents: bool) -> float:
    """Edit distance of the ordered trees (table, rows, cells) of two tables, by Zhang and Shasha's keyroots.

    Inserting or deleting a node costs 1, as does renaming across kinds; a cell costs its normalised edit distance to
    rename, or nothing if only structure counts.
    """
    p, q = _ordered(a), _ordered(b)

    def rename(x: tuple, y: tuple) -> float:
        if x[0] != y[0]:
            return 1.0
        if x[0] != "td" or not contents:
            return 0.0
        s, t = ("".join(str(v[1]).split()) for v in (x, y))
        return sequence_distance(list(s), list(t)) / max(len(s), len(t), 1)

    change = [[rename(x, y) for y in q] for x in p]
    keyroots = lambda t: sorted({left: i for i, (_, _, left) in enumerate(t)}.values())
    whole = np.zeros((len(p), len(q)))
    for i in keyroots(p):
        for j in keyroots(q):
            x0, y0 = p[i][2], q[j][2]
            forest = np.zeros((i - x0 + 2, j - y0 + 2))
            forest[:, 0], forest[0, :] = np.arange(len(forest)), np.arange(forest.shape[1])
            for x in range(x0, i + 1):
                for y in range(y0, j + 1):
                    u, v = x - x0 + 1, y - y0 + 1
                    alone = min(forest[u - 1, v], forest[u, v - 1]) + 1
                    if p[x][2] == x0 and q[y][2] == y0:
                        forest[u, v] = whole[x, y] = min(alone, forest[u - 1, v - 1] + change[x][y])
                    else:
                        forest[u, v] = min(alone, forest[p[x][2] - x0, q[y][2] - y0] + whole[x, y])
    return float(whole[-1, -1])


def table_similarity(a: list[list[str]], b: list[list[str]], contents: bool = True) -> float:
    size = max(1 + sum(1 + len(r) for r in t) for t in (a, b))
    return max(0.0, 1 - table_tree_distance(a, b, contents) / size)


@F.pandas_udf(T.StructType([T.StructField("content", T.DoubleType()), T.StructField("structure", T.DoubleType())]))
def table_trees(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Tree similarity of two arrays of rows, with cell contents and by structure alone."""
    as_rows = lambda t: [[c or "" for c in r] for r in t]
    pairs = [(as_rows(x), as_rows(y)) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame({"content": [table_similarity(x, y) for x, y in pairs], "structure": [table_similarity(x, y, False) for x, y in pairs]})
