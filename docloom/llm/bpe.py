"""Byte-level BPE: encoding with a queue of merge ranks over a linked symbol list, and decoding.

The vocabulary is read once on the driver (its path is a parameter) and broadcast: its size is that
of the vocabulary file, whatever the corpus. Texts of Latin letters are cut into pre-tokens at once;
others into chunks of one blank and a run of non-blanks, or of blanks, which no pre-token crosses. The
ids of a pre-token or chunk are kept in a bounded cache of the worker, so most cost one look-up.

Defined cases: a null text counts as an empty one; an empty text has no ids and decodes to ''; the
strings of special tokens in a text become these tokens; rows with the same id stay separate rows;
other columns are kept as they are, save those named like an output column, which are replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import kept, slices

_BLANK = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
#: Fixed value: the pre-token pattern of the published byte-level vocabularies.
_PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
#: The letters and numbers up to U+024F, and what is not a character up to there or of general punctuation.
_LETTER, _NUMBER, _OTHER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e]")
#: The same pre-tokens in a text without _OTHER, by a pattern that needs no table of Unicode.
_LATIN = re.compile(f" ?[{_LETTER}]+| ?[{_NUMBER}]+|'(?:[stmd]|re|ve|ll)| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
#: Chunks and pre-tokens in a generation of a worker's cache, and the longest kept: an entry has some 250 bytes, and there are two generations.
CACHE, CACHE_CHARS = 200_000, 48


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def refuse_others(spec: dict) -> None:
    """An error for a file whose settings this coder doesn't follow: ids of another normaliser, pre-tokenizer or model would be wrong ones."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    odd = [f"normalizer {spec['normalizer']}"] if spec.get("normalizer") else []
    odd += [] if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) else [f"pre_tokenizer {pre}"]
    odd += [] if model.get("type", "BPE") == "BPE" else [f"model {model['type']}"]
    odd += [f"{k} {model[k]}" for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [f"added token {t['content']!r}" for t in spec.get("added_tokens") or [] if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized")]
    if odd:
        raise ValueError("not a plain byte-level BPE vocabulary: " + ", ".join(odd))


def cut(text: str) -> list[str]:
    """The pre-tokens of a text of Latin letters, the chunks of another."""
    return (_CHUNK if _OTHER.search(text) else _LATIN).findall(text)


class Coder(dict):
    """Maps a chunk of text to its packed ids (little-endian uint32), computing what is not cached."""

    def __init__(self, spec: str):
        import regex

        loaded = json.loads(spec)
        model = loaded["model"]
        refuse_others(loaded)
        vocab: dict[str, int] = model["vocab"]
        chars = byte_characters()
        of_char = {c: bytes([b]) for b, c in enumerate(chars)}
        self.first = [vocab[c] for c in chars]
        #: Rank by pair (left << 16 | right, symbols below 65536 as a rule; more bits if not), and by pair of bytes.
        self.bits = max(16, max(vocab.values()).bit_length())
        self.ranks: dict[int, int] = {}
        self.joined: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[left] << self.bits | vocab[right], rank)
            self.joined.append(vocab[left + right])
        self.of_bytes = [self.ranks.get(a << self.bits | b, -1) for a in self.first for b in self.first]
        self.old: dict[str, bytes] = {}  # the cache has two generations
        added = {t["content"]: t["id"] for t in loaded.get("added_tokens") or []}
        self.strings = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, number in [*vocab.items(), *added.items()]:
            self.strings[number] = b"".join(of_char.get(c, c.encode()) for c in token)
        self.special = {t: number.to_bytes(4, "little") for t, number in added.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pieces = regex.compile(_PIECE).findall

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one pre-token. Queue entries pack (rank, place); one whose pair no longer has that rank is stale and skipped. Behind the last symbol and in place of merged ones stands -1, which pairs with nothing."""
        first, of_bytes, ranks, joined, bits = self.first, self.of_bytes, self.ranks, self.joined, self.bits
        n = len(piece)
        shift = 14 if n <= 1 << 14 else 40  # short entries are the faster ones
        queue = [rank << shift | i for i, rank in enumerate([of_bytes[a << 8 | b] for a, b in zip(piece, piece[1:])]) if rank >= 0]  # noqa: B905
        ids = [first[b] for b in piece]
        if not queue:
            return ids
        heapify(queue)
        ids.append(-1)
        after, before, place = [*range(1, n + 1)], [*range(-1, n)], (1 << shift) - 1
        while queue:
            entry = heappop(queue)
            i = entry & place
            j = after[i]
            pair = ids[i] << bits | ids[j]
            if pair not in ranks or ranks[pair] != entry >> shift:
                continue
            ids[i] = new = joined[entry >> shift]
            ids[j] = -1
            after[i] = k = after[j]
            before[k] = i
            if (pair := new << bits | ids[k]) in ranks:
                heappush(queue, ranks[pair] << shift | i)
            h = before[i]
            if (pair := ids[h] << bits | new) in ranks:
                heappush(queue, ranks[pair] << shift | h)
        return [x for x in ids if x >= 0]

    def __missing__(self, chunk: str) -> bytes:
        if (packed := self.old.get(chunk)) is None:
            whole = _LATIN.fullmatch(chunk) and not _OTHER.search(chunk)  # one pre-token, seen at a glance
            if whole or len(pieces := self.pieces(chunk)) == 1:
                ids = self.merged(chunk.encode())
                packed = pack(f"<{len(ids)}I", *ids)
            else:
                packed = b"".join([self[piece] for piece in pieces])
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[chunk] = packed
        return packed

    def encode(self, text: str) -> bytes:
        look = self.__getitem__
        if self.at_special is None or not self.at_special.search(text):
            return b"".join(map(look, cut(text)))
        return b"".join(self.special[part] if part in self.special else b"".join(map(look, cut(part))) for part in self.at_special.split(text))

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


def _vocabulary(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _mapped(df: DataFrame, source: str, targets: dict[str, T.DataType], make, spec) -> DataFrame:
    """df with the columns ``targets`` made from ``source`` by make(coder)(value), a tuple, in small Arrow batches."""
    df = df.drop(*(t for t in targets if t != source))
    schema = T.StructType([*df.schema.fields, *(T.StructField(t, kind) for t, kind in targets.items())])
    kinds = [pa.binary() if isinstance(kind, T.BinaryType) else pa.string() for kind in targets.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = make(kept(spec.value, Coder))
        for batch in slices(batches, source, keeps=True):
            made = zip(*map(do, batch.column(source).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(m, kind) for m, kind in zip(made, kinds, strict=True))], [*batch.schema.names, *targets])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with ``ids``: the token ids of the whole text, packed as little-endian unsigned 32-bit integers."""
    return _mapped(docs, text, {ids: T.BinaryType()}, lambda coder: lambda v: (coder.encode(v or ""),), _vocabulary(docs, vocabulary))


def decode(docs: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with ``decoded``: the concatenated vocabulary strings of packed ids (null: empty), read as UTF-8."""
    return _mapped(docs, ids, {decoded: T.StringType()}, lambda coder: lambda v: (coder.decode(v or b""),), _vocabulary(docs, vocabulary))


def encode_and_decode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with ``ids`` of the text and ``decoded`` from these ids, in one pass: one worker a task, not two."""

    def make(coder: Coder):
        def do(value: str | None) -> tuple[bytes, str]:
            packed = coder.encode(value or "")
            return packed, coder.decode(packed)

        return do

    return _mapped(docs, text, {ids: T.BinaryType(), decoded: T.StringType()}, make, _vocabulary(docs, vocabulary))


def id_array(ids: str = "ids"):
    """A column expression: packed ids as an array of longs, by built-in functions."""
    octets = F.hex(F.col(ids))
    place = lambda i, k: F.substring(octets, i * 8 + 1 + 2 * k, F.lit(2))
    number = lambda i: F.conv(F.concat(*(place(i, k) for k in (3, 2, 1, 0))), 16, 10).cast("long")
    n = (F.length(F.col(ids)) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), number)).otherwise(F.array().cast("array<long>"))
