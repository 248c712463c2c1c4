"""Substring dedup: content-defined chunking with a gear rolling hash, chunks deduplicated by digest.

The gear hash at a byte depends on the 32 bytes up to it; a chunk ends where its lowest ``bits`` bits are zero, at
least ``least`` and at most ``most`` bytes after the last end. An insertion moves only the ends near
it, so a passage shared by two texts is cut alike save at its rims. Chunks are numbered rows of digests;
the first by (row key, start) of each digest is the original, and later ones are copies. A run of copies is extended to
the left and right as far as its bytes are those around the original of its first and last chunk, up to ``RIM`` bytes, and deleted if it then has at least
``min_bytes`` bytes; single chunks that agree by chance stay. A text that equals an earlier one by the digest of the whole is
deleted at any length. Each byte deleted stands at an earlier place too, so what it says is kept once.

Rows of chunks hold a digest of 64 bits, a check of 19 from the gear hashes (which see 32 bytes: shorter chunks have
none) and the size, which all must agree, and never texts. Digests are first reduced to (digest, first) by partial aggregates, so a chunk that is in a third of
the texts is one row for each task there; what is found is written, so that the join of chunks with it
deals them anew and those of a frequent digest can be split among tasks.

Defined cases: a null text counts as an empty one and stays null; an empty text has no chunks;
offsets count UTF-8 bytes and are moved inward to whole characters; repeated ids are separate rows,
in the order of their row keys; extra columns stay, save those named like the output's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from docloom.llm.common import by_id, row_keyed, set_aside, slices, staged, utf8
from docloom.llm.shingles import mixed, powers

LEAST, BITS, MOST, MIN_BYTES = 16, 5, 256, 128
#: How far a run is extended: a chunk that isn't a copy begins or ends within the passage, and the two texts may be cut at different places once more.
RIM = 2 * MOST
SEED = 7


@lru_cache(maxsize=2)
def gear(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(joined: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The gear hash at every byte: the sum over the last 32 bytes of gear[byte] << age, by doubling."""
    h = gear(seed)[joined]
    for k in (1, 2, 4, 8, 16):
        older = np.zeros_like(h)
        older[k:] = h[:-k]
        h = h + (older << np.uint32(k))
    return h


def ends(h: np.ndarray, first: int, last: int, least: int, bits: int, most: int) -> list[int]:
    """Chunk ends of the bytes [first, last), given the gear hash of all bytes; the hash looks only at bytes of the text once 32 are passed."""
    cuts = (np.flatnonzero((h[first:last] & np.uint32((1 << bits) - 1)) == 0) + first + 1).tolist()
    out, at = [], first
    for cut in cuts:
        while cut - at > most:
            at += most
            out.append(at)
        if cut - at >= least:
            out.append(at := cut)
    while last - at > most:
        at += most
        out.append(at)
    if at < last:
        out.append(last)
    return out


#: A chunk's start, size, whether it ends its text, and check bits, in one long of 32 + 12 + 1 + 19 bits.
START, SIZE, LAST = 1 << 32, 1 << 20, 1 << 19


def chunks(docs: DataFrame, least: int = LEAST, bits: int = BITS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(row_key, digest, span) of the chunks of (row_key, text); ``most`` is below 2**12."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = list(utf8(batch.column("text")))
            keys = batch.column("row_key").to_numpy(zero_copy_only=False)
            joined = np.frombuffer(b"".join(texts), np.uint8)
            if not len(joined):
                continue
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            h = rolling(joined, seed)
            # bytes of the text before must not count in the first 31 hashes of a text
            for at in offsets[1:-1].tolist():
                if at < len(joined):
                    h[at : at + 31] = rolling(joined[at : at + 31], seed)
            every = [ends(h, a, b, least, bits, most) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            many = np.array([len(e) for e in every])
            end = np.array([x for e in every for x in e])
            place = np.arange(len(end)) - np.repeat(np.cumsum(many) - many, many)
            base = np.repeat(offsets[:-1], many)
            start = np.where(place == 0, base, np.concatenate([[0], end[:-1]]))
            up, down = powers(len(joined) + 1)
            total = np.zeros(len(joined) + 1, np.uint64)
            np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[: len(joined)], out=total[1:])
            digest = mixed(mixed((total[end] - total[start]) * down[start]) + (end - start).astype(np.uint64))
            # the check sums bytes in other weights: the gear hashes at a few places of the chunk, which see 32 bytes each
            check = np.zeros(len(end), np.uint64)
            for part in range(1, 5):
                near = start + (end - start) * part // 4 - 1
                inside = near - start >= 31  # else the hash would see bytes before the chunk
                check = mixed(check + np.where(inside, h[near], 0).astype(np.uint64) + np.uint64(part))
            span = (start - base) * START + (end - start) * SIZE + np.isin(end, offsets[1:]) * LAST + (check & np.uint64(LAST - 1)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"row_key": pa.array(np.repeat(keys, many)), "digest": pa.array(digest.view(np.int64)), "span": pa.array(span)})

    return docs.select("row_key", "text").mapInArrow(run, "row_key long, digest long, span long")


def whole_copies(docs: DataFrame) -> DataFrame:
    """(row_key, source_key) of texts that an earlier row has, by the digest of the whole."""
    told = staged(docs.where("text <> ''").select("row_key", F.sha2("text", 256).alias("digest")), "wholes")
    first = staged(told.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("row_key").alias("source_key")).where("n > 1").select("digest", "source_key"), "firsts")
    return told.join(first, "digest").where("row_key <> source_key").select("row_key", "source_key")


def copied_runs(docs: DataFrame, **cut: int) -> DataFrame:
    """(row_key, start, end, left, right): stretches of copied chunks; left: struct(key, at) where the original of the first chunk begins, right: where that of the last one ends.

    What is shuffled of a chunk is its digest, its row and its span.
    """
    table = staged(chunks(docs, **cut), "chunks")
    first = staged(table.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_key", "span")).alias("first")).where("n > 1").select("digest", "first"), "firsts")
    # size and check; a copy agrees in both
    agree = F.col("span").bitwiseXOR(F.col("first.span")).bitwiseAND(F.lit((START - 1) ^ LAST)) == 0
    copies = table.join(first, "digest").where(agree & ((F.col("row_key") != F.col("first.row_key")) | (F.col("span") != F.col("first.span"))))
    begin = lambda span: F.shiftright(span, 32).cast("int")
    size = F.shiftright("span", 20).bitwiseAND(F.lit((1 << 12) - 1)).cast("int")
    copies = copies.select("row_key", begin(F.col("span")).alias("start"), (begin(F.col("span")) + size).alias("end"), F.col("first.row_key").alias("key"), begin(F.col("first.span")).alias("a"), (begin(F.col("first.span")) + size).alias("b"))
    ordered = W.partitionBy("row_key").orderBy("start")
    opens = (F.col("start") != F.coalesce(F.lag("end").over(ordered), F.lit(-1))).cast("int")
    place = lambda c: F.struct("key", F.col(c).alias("at"))
    return (
        copies.withColumn("opens", opens)
        .withColumn("run", F.sum("opens").over(ordered))
        .groupBy("row_key", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by(place("a"), "start").alias("left"), F.max_by(place("b"), "start").alias("right"))
        .drop("run")
    )


def rims(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(key, at, side, rim): up to RIM bytes before (side 0) or behind (side 1) each place (key, at, side) of the texts."""
    asked = places.groupBy(F.col("key").alias("row_key")).agg(F.collect_list(F.struct("at", "side")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, at, side, found = [], [], [], []
            for key, text, wanted in zip(batch.column("row_key").to_pylist(), utf8(batch.column("text")), batch.column("places").to_pylist(), strict=True):
                for x in wanted:
                    keys.append(key)
                    at.append(x["at"])
                    side.append(x["side"])
                    found.append(text[x["at"] : x["at"] + RIM] if x["side"] else text[max(0, x["at"] - RIM) : x["at"]])
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "at": pa.array(at, pa.int32()), "side": pa.array(side, pa.int32()), "rim": pa.array(found, pa.binary())})

    return docs.select("row_key", "text").join(asked, "row_key").mapInArrow(run, "key long, at int, side int, rim binary")


def same_before(text: bytes, end: int, rim: bytes) -> int:
    """How many bytes before text[end:] are the last ones of the rim."""
    n = 0
    while n < min(end, len(rim)) and text[end - 1 - n] == rim[len(rim) - 1 - n]:
        n += 1
    return n


def same_behind(text: bytes, start: int, rim: bytes) -> int:
    """How many bytes of text[start:] are the first ones of the rim."""
    n = 0
    while n < min(len(text) - start, len(rim)) and text[start + n] == rim[n]:
        n += 1
    return n


def extended(text: bytes, edges: list[dict], min_bytes: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Runs extended by the rims of their edges, those that touch taken as one, and the sources of the ones of min_bytes or more."""
    runs: dict[tuple[int, int], list] = {}
    for e in edges:
        run = runs.setdefault((e["start"], e["end"]), [e["start"], e["end"], []])
        run[2].append(e["key"])
        if e["side"]:
            run[1] = e["end"] + same_behind(text, e["end"], e["rim"])
        else:
            run[0] = e["start"] - same_before(text, e["start"], e["rim"])
    merged: list[list] = []
    for a, b, keys in sorted(runs.values(), key=lambda r: r[:2]):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
            merged[-1][2] += keys
        else:
            merged.append([a, b, list(keys)])
    kept = [m for m in merged if m[1] - m[0] >= min_bytes]
    return [(a, b) for a, b, _ in kept], [k for m in kept for k in m[2]]


def _without(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The text less its spans, each moved inward to whole characters, and the spans so moved."""
    out, done, at = [], [], 0
    for a, b in sorted(spans):
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append(text[at:a])
            at = b
            done.append((a, b))
    return b"".join([*out, text[at:]]), done


def dedup_substrings(docs: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", **cut: int) -> DataFrame:
    """docs with ``text`` less copied stretches, ``removed_bytes``, ``spans`` (array of start, end in UTF-8 bytes of the given text) and ``copied_from``, the sorted ids whose texts hold the originals."""
    docs, restored = set_aside(docs.drop("removed_bytes", "spans", "copied_from"), "row_key", "_edges", "_whole")
    keyed = row_keyed(docs, id_col)
    texts = keyed.select("row_key", "text")
    wholes = staged(whole_copies(texts), "wholes")
    runs = staged(copied_runs(texts.join(wholes, "row_key", "left_anti"), **cut), "runs")
    edges = runs.select("row_key", "start", "end", F.explode(F.array(F.struct("left.key", "left.at", F.lit(0).alias("side")), F.struct("right.key", "right.at", F.lit(1).alias("side")))).alias("e")).select("row_key", "start", "end", "e.*")
    around = staged(rims(texts, edges.select("key", "at", "side").distinct()), "rims")
    edges = edges.join(around, ["key", "at", "side"])
    if by_id(keyed):
        named = lambda df, key: df.withColumn("source", F.col(key))
    else:
        named = lambda df, key: df.join(keyed.select(F.col("row_key").alias(key), F.col(id_col).alias("source")), key)
    edges = named(edges, "key")
    per_row = staged(edges.groupBy("row_key").agg(F.collect_list(F.struct("start", "end", "side", "rim", F.col("source").alias("key"))).alias("_edges")), "edges")
    wholes = named(wholes, "source_key").select("row_key", F.struct("source").alias("_whole"))
    wide = keyed.join(per_row, "row_key", "left").join(wholes, "row_key", "left").drop("row_key")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    kept = [c for c in docs.columns if c != "text"]
    sources = T.ArrayType(docs.schema[id_col].dataType)
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("copied_from", sources), T.StructField("text", T.StringType()), T.StructField("removed_bytes", T.LongType()), T.StructField("spans", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, removed, spans, origins = [], [], [], []
            for text, own, whole in zip(batch.column("text").to_pylist(), batch.column("_edges").to_pylist(), batch.column("_whole").to_pylist(), strict=True):
                found, its = [], []
                raw = text.encode() if own or whole else b""
                if whole:
                    found, its = [(0, len(raw))], [whole["source"]]
                elif own:
                    found, its = extended(raw, own, min_bytes)
                cut_text, done = _without(raw, found) if found else (raw, [])
                texts.append(cut_text.decode() if found else text)
                removed.append(len(raw) - len(cut_text))
                spans.append([{"start": a, "end": b} for a, b in done])
                origins.append(sorted({x for x in its if x is not None}) + ([None] if None in its else []))
            made = [pa.array(origins, pa.list_(batch.schema.field(id_col).type)), pa.array(texts, pa.string()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, "copied_from", "text", "removed_bytes", "spans"])

    return restored(wide.mapInArrow(run, schema).select(*docs.columns, "removed_bytes", "spans", "copied_from"))
