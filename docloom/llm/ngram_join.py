"""Self-join of documents by the Jaccard similarity of their word shingles: a grouped prefix join.

1. One pass over the texts gives each set's size and digest and a sketch of how often shingles occur.
   Equal sets become one class.
2. A second pass orders each class's set by (sketched frequency level, hash), rarest first, and keeps the
   prefix in which two similar sets must meet, and 256 parity bits of the set. Classes with the same prefix
   and size form a group.
3. Leaders: members are verified against one leader of each bucket of their first prefix tokens of the highest
   level. What is found joins most near copies, at one pair for each member and round; members of one
   component need no further pair.
4. The rest is exact: groups that share a prefix token and hold different components are paired if they
   pass the size, position and parity filters (sets that differ in more parity bits than the threshold
   allows can't be similar), expanded to their members, and members are verified on their whole sets. Of a large
   bucket only groups outside its largest component are paired with the others, in salted parts.

So no link between components is lost, and a group of thousands of near copies gives a few pairs
for each member. Rows of pairs are made only where all filters pass. Joins of a bucket, class or
component with what is known of it read that from a written table, so that rows of a hot one can be split.

Whole sets are shuffled only for documents in a pair, found at the scan by a bit set of fixed size.

Defined cases: texts null, empty or blank have no shingles and link with nothing; a text with fewer
words than a shingle is one shingle; copies are one class; repeated ids are separate rows of a
common id; a null id is an id of its own for each row in linking. Extra columns are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import arrow_rows, by_id, collected, passing, row_keyed, set_aside, slices, staged, utf8
from docloom.llm.components import stars
from docloom.llm.shingles import shingle_sets

#: Buckets up to so many groups give all their pairs; so many rounds of leaders go before the rest is paired.
SMALL, ROUNDS = 16, 2
#: Rows of a large bucket that one task pairs with those outside the bucket's largest component.
SALT_ROWS = 4096
#: Most bits of a bit set (a broadcast of 8 MB); more keys than bits only let more rows pass. Few keys get fewer: at least so many for each.
SET_BITS, KEY_BITS = 26, 128
#: Cells of the frequency sketch, in parts that are summed apart.
CELLS, PARTS = 1 << 20, 64


class Threshold:
    """Similar: q * intersection >= p * union, in whole numbers."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q

    def prefix(self, n: int) -> int:
        return n - (self.p * n + self.q - 1) // self.q + 1

    def reachable(self, n: int) -> bool:
        """An unlike set can be similar: a smaller or equal one if the prefix has more than one token, or one with an element more."""
        return n > 0 and (self.prefix(n) > 1 or self.q * n >= self.p * (n + 1))

    def sizes(self, a: Column, b: Column) -> Column:
        return F.least(a, b) * self.q >= F.greatest(a, b) * self.p

    def positions(self, n: Column, i: Column, m: Column, j: Column) -> Column:
        """If the shared tokens at places i and j are the sets' first, they can still share enough."""
        return F.least(n - i, m - j) * (self.p + self.q) >= (n + m) * self.p

    def parities(self, n: Column, m: Column, differ: Column) -> Column:
        """The sets differ in at least as many elements as their parity bits do."""
        return differ * (self.p + self.q) <= (n + m) * (self.q - self.p)

    def similar(self, shared: int, n: int, m: int) -> bool:
        return self.q * shared >= self.p * (n + m - shared)


def measured(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """(row_key, n, digest) of every document of (row_key, text), and log2 levels of the sketched frequencies."""
    per_part = CELLS // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in slices(batches):
            sets = shingle_sets(list(utf8(batch.column("text"))), words)
            for s in sets:
                cells[s & np.uint64(CELLS - 1)] += 1  # within a set a cell counts once
            yield pa.RecordBatch.from_pydict(
                {
                    "row_key": batch.column("row_key"),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    "part": pa.nulls(len(sets), pa.int32()),
                    "counts": pa.nulls(len(sets), pa.binary()),
                }
            )
        for part in range(PARTS):
            own = cells[part * per_part : (part + 1) * per_part]
            if (at := np.flatnonzero(own)).size:
                packed = np.stack([at, own[at]]).astype("<u4").tobytes() if 2 * len(at) < per_part else own.astype("<u4").tobytes()
                yield pa.RecordBatch.from_pydict({"row_key": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64()), "digest": pa.nulls(1, pa.binary()), "part": pa.array([part], pa.int32()), "counts": pa.array([packed], pa.binary())})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
                total = held.setdefault(part, np.zeros(per_part, np.int64))
                got = np.frombuffer(counts.as_py(), "<u4")
                if len(got) == per_part:
                    total += got
                else:
                    at, n = got.reshape(2, -1)
                    total[at] += n
        for part, total in held.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "levels": pa.array([np.log2(total + 1).astype(np.uint8).tobytes()], pa.binary())})

    both = staged(docs.select("row_key", "text").mapInArrow(run, "row_key long, n long, digest binary, part int, counts binary"), "sets")
    levels = np.zeros((PARTS, per_part), np.uint8)
    for row in collected(both.where("part IS NOT NULL").select("part", "counts").repartition(PARTS, "part").mapInArrow(summed, "part int, levels binary")):  # one byte a cell
        levels[row["part"]] = np.frombuffer(row["levels"], np.uint8)
    return both.where("part IS NULL").select("row_key", "n", "digest"), levels.reshape(-1)


def in_order(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A set's hashes by (frequency level, hash): one order for all sets, rare ones first."""
    return s[np.argsort(levels[s & np.uint64(CELLS - 1)], kind="stable")]


def bit_set(cells: DataFrame) -> np.ndarray:
    """The bits of one column of long, modulo a power of two up to 2**SET_BITS, packed; made in the tasks, merged by blocks of 4 KB.

    Every executor and worker keeps a set that is broadcast, in memory and on disk, so one of few keys is folded.
    """
    cell = F.pmod(F.col(cells.columns[0]), F.lit(1 << SET_BITS)) + 1
    blocks = cells.select(cell.alias("c")).groupBy(F.bitmap_bucket_number("c").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("bits"))
    out = np.zeros(1 << SET_BITS - 3, np.uint8)
    with arrow_rows(cells.sparkSession):
        rows = collected(blocks)  # 2**SET_BITS bits at most
    for row in rows:
        at = (row["block"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    n = int(np.bitwise_count(out).sum())
    while len(out) > 64 and n * KEY_BITS <= 4 * len(out):
        out = out[: len(out) // 2] | out[len(out) // 2 :]
    return out


def in_set(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    c = cells.astype(np.int64) & (8 * len(bits) - 1)
    return (bits[c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool)


def texts_in(docs: DataFrame, keys: DataFrame, words: int, schema: str, make) -> DataFrame:
    """make(row keys, shingle sets) -> record batch, over documents whose row_key is in keys(row_key), and perhaps few more."""
    wanted = docs.sparkSession.sparkContext.broadcast(bit_set(keys.select(F.xxhash64("row_key"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            for part in slices(iter([batch.filter(pa.array(in_set(bits, batch.column("cell").to_numpy())))])):
                yield make(part.column("row_key"), shingle_sets(list(utf8(part.column("text"))), words))

    return docs.select("row_key", "text", F.xxhash64("row_key").alias("cell")).mapInArrow(run, schema)


SKETCH = ["s0", "s1", "s2", "s3"]


#: Sets of more hashes than SPARSE have FINE parity bits at least, besides the 256 of SKETCH.
SPARSE, FINE = 64, 1024


def parity_bits(s: np.ndarray) -> np.ndarray:
    """Parities of a set's hashes as bytes: 256 bits for small sets, else FINE or four times as many as hashes, a power of two. The parities of fewer bits are those of more, folded."""
    bits = 256 if len(s) <= SPARSE else 1 << min(20, max(FINE.bit_length() - 1, (4 * len(s) - 1).bit_length()))
    return np.packbits((np.bincount((s >> np.uint64(40)).astype(np.int64) & bits - 1, minlength=bits) & 1).astype(np.uint8), bitorder="little")


def fold(parities: np.ndarray, size: int) -> np.ndarray:
    """Parities folded to ``size`` bytes."""
    return np.bitwise_xor.reduce(parities.reshape(-1, size), axis=0)


def prefixes(docs: DataFrame, keys: DataFrame, words: int, limit: Threshold, levels: np.ndarray) -> DataFrame:
    """(row_key, n, prefix, anchors, parities, fine, s0..s3) of documents in keys that can be similar to an unlike set.

    prefix: packed int64 tokens in order; anchors: the first two of the highest level in it; s0..s3: the parities folded to 256 bits; fine: to FINE bits, null for sets up to SPARSE.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def make(row_keys: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        own = shared.value
        at = [i for i, s in enumerate(sets) if limit.reachable(len(s))]
        firsts, anchors = [], []
        for s in (sets[i] for i in at):
            first = in_order(s, own)[: limit.prefix(len(s))]
            level = own[first & np.uint64(CELLS - 1)]
            firsts.append(first.astype("<i8").tobytes())
            anchors.append(first[np.flatnonzero(level == level[-1])[:2]].astype(np.int64))
        parities = [parity_bits(sets[i]) for i in at]
        bits = np.stack([fold(x, 32) for x in parities]).view(np.int64) if at else np.zeros((0, 4), np.int64)
        return pa.RecordBatch.from_pydict(
            {
                "row_key": row_keys.take(pa.array(at, pa.int64())),
                "n": pa.array([len(sets[i]) for i in at], pa.int64()),
                "prefix": pa.array(firsts, pa.binary()),
                "anchors": pa.array(anchors, pa.list_(pa.int64())),
                "parities": pa.array([x.tobytes() for x in parities], pa.binary()),
                "fine": pa.array([fold(x, FINE // 8).view(np.int64) if len(x) > 32 else None for x in parities], pa.list_(pa.int64())),
            }
            | {name: pa.array(np.ascontiguousarray(bits[:, i])) for i, name in enumerate(SKETCH)}
        )

    return texts_in(docs, keys, words, "row_key long, n long, prefix binary, anchors array<long>, parities binary, fine array<long>, s0 long, s1 long, s2 long, s3 long", make)


def tokens_of(prefixed: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """(token, gid, n, place) of (row_key, n, prefix); ``only``: a bit set that tokens must be in."""
    wanted = None if only is None else prefixed.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [np.frombuffer(p, "<i8") for p in batch.column("prefix").to_pylist()]
            long = np.array([len(a) for a in arrays])
            for at in range(0, len(arrays), 512):
                some, k = arrays[at : at + 512], long[at : at + 512]
                tokens = np.concatenate(some)
                kept = slice(None) if wanted is None else in_set(wanted.value, tokens)
                yield pa.RecordBatch.from_pydict(
                    {
                        "token": pa.array(tokens[kept]),
                        "gid": pa.array(np.repeat(batch.column("row_key").to_numpy()[at : at + 512], k)[kept]),
                        "n": pa.array(np.repeat(batch.column("n").to_numpy()[at : at + 512], k)[kept]),
                        "place": pa.array((np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)).astype(np.int32)[kept]),
                    }
                )

    return prefixed.select("row_key", "n", "prefix").mapInArrow(run, "token long, gid long, n long, place int")


def kept_tokens(prefixed: DataFrame, only: np.ndarray, most: int = 64) -> DataFrame:
    """(gid, kept) of (row_key, prefix): the prefix's tokens in the bit set, in order; null for more than ``most``."""
    wanted = prefixed.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(t := np.frombuffer(p, "<i8"))[in_set(wanted.value, t)] for p in batch.column("prefix").to_pylist()]
            yield pa.RecordBatch.from_pydict({"gid": batch.column("row_key"), "kept": pa.array([k if len(k) <= most else None for k in kept], pa.list_(pa.int64()))})

    return prefixed.select("row_key", "prefix").mapInArrow(run, "gid long, kept array<long>")


def packed48(s: np.ndarray) -> bytes:
    """A sorted set's hashes by their upper 48 bits: two among n and m unlike hashes agree with probability n * m / 2**48."""
    return np.ascontiguousarray(s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpacked48(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def verified(pairs: DataFrame, prefixed: DataFrame, docs: DataFrame, words: int, limit: Threshold) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar.

    Parity bits are compared first. Sets of what is left are computed from the texts, meet their pairs by document and
    then each other by pair: no key of the second shuffle is hot. Sides grow with the documents and are never broadcast.
    """
    one = prefixed.select(F.col("row_key").alias("a"), F.col("n").alias("an"), F.col("parities").alias("ap")).hint("merge")
    two = prefixed.select(F.col("row_key").alias("b"), F.col("n").alias("bn"), F.col("parities").alias("bp")).hint("merge")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n in zip(batch.column("ap"), batch.column("bp"), batch.column("both").to_pylist(), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                size = min(len(x), len(y))
                differ = int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())
                keep.append(differ * (limit.p + limit.q) <= n * (limit.q - limit.p))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(one, "a").join(two, "b").where(limit.sizes(F.col("an"), F.col("bn"))).select("a", "b", "ap", "bp", (F.col("an") + F.col("bn")).alias("both"))
    def make(row_keys: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"row_key": row_keys, "hashes": pa.array([packed48(s) for s in sets], pa.binary())})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, bytes] | None = None  # rows of a pair follow each other
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b, hashes in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("hashes"), strict=True):
                if held is None or held[:2] != (a, b):
                    held = (a, b, hashes.as_py())
                    continue
                x, y = unpacked48(held[2]), unpacked48(hashes.as_py())
                merged = np.sort(np.concatenate([x, y]), kind="stable")
                if limit.similar(int((merged[1:] == merged[:-1]).sum()), len(x), len(y)):
                    found.append((a, b))
                held = None
            if found:
                yield pa.RecordBatch.from_pydict({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    with passing(docs.sparkSession) as stays:
        sides = staged(met.mapInArrow(near, "a long, b long"), "pairs").select(F.explode(F.array("a", "b")).alias("row_key"), "a", "b")
        sets = texts_in(docs, sides.select("row_key"), words, "row_key long, hashes binary", make)
        both = sets.join(sides.hint("merge"), "row_key").select("a", "b", "hashes")
        return stays(staged(both.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(compare, "a long, b long"), "links"))


def _pair(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def led(rows: DataFrame, labels: DataFrame | None, turn: int, limit: Threshold) -> DataFrame:
    """Pairs (a, b) of (token, key, n, copies): each key with at most one leader of its buckets, of another component.

    The set with most copies leads, likely what others are near copies of; in later rounds one drawn by hash.
    """
    own = F.col("key") if labels is None else F.coalesce("label", "key")
    now = (rows if labels is None else rows.join(labels, rows["key"] == labels["node"], "left")).select("token", "key", "n", "copies", own.alias("label"))
    if labels is not None:
        now = staged(now, "labelled")  # read twice
    drawn = F.xxhash64("key", F.lit(turn))
    first = F.min(F.struct((F.struct(-F.col("copies"), drawn) if turn == 0 else F.struct(F.lit(0).cast("long"), drawn)).alias("h"), "key", "n", "label"))
    # written, so that the join deals rows anew and a frequent token's can be split
    state = staged(now.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), first.alias("lead")).where("low <> high"), "leads")
    lead = state.select("token", *(F.col(f"lead.{c}").alias(f"lead_{c}") for c in ("h", "key", "n", "label")))
    both = now.join(lead, "token").where((F.col("label") != F.col("lead_label")) & limit.sizes(F.col("n"), F.col("lead_n")))
    return both.groupBy("key").agg(F.min(F.struct("lead_h", "lead_key")).alias("lead")).select("key", F.col("lead.lead_key").alias("lead_key")).select(*_pair("key", "lead_key"))


def crossing(rows: DataFrame, limit: Threshold) -> DataFrame:
    """Pairs (g, h) of keys of (bucket, key, n, place, low, high, kept, fine, s0..s3) in one large bucket that may be similar and are of different components.

    low and high: the least and greatest component of the key's members; s0 is null where they have several sets; kept: the
    key's buckets in order, or null: a pair is made in the first bucket common to both.
    Rows outside the bucket's largest component meet all rows of the bucket, in parts of about SALT_ROWS.
    """
    counts = rows.groupBy("bucket", "low", "high").agg(F.count(F.lit(1)).alias("k"))
    state = staged(counts.groupBy("bucket").agg(F.max(F.when(F.col("low") == F.col("high"), F.struct("k", "low"))).alias("main"), F.ceil(F.sum("k") / SALT_ROWS).alias("parts")), "buckets")
    known = rows.join(state.select("bucket", F.coalesce("main.low", F.lit(-1)).alias("main"), "parts"), "bucket")
    known = known.withColumn("outside", (F.col("low") != F.col("main")) | (F.col("high") != F.col("main")))
    l = known.where("outside").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).alias("l")
    r = known.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))).alias("r")
    a, b = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    once = (a("key") < b("key")) | (~b("outside") & (a("key") != b("key")))
    earlier = lambda x: F.slice(x("kept"), 1, F.array_position(x("kept"), x("bucket")).cast("int") - 1)
    first = ~F.coalesce(F.arrays_overlap(earlier(a), earlier(b)), F.lit(False))
    met = l.join(r, (a("bucket") == b("bucket")) & (a("part") == b("part")) & once & unlike(a, b) & close(a, b, limit) & finely_close(a, b, limit) & first)
    return met.select(a("key").alias("g"), b("key").alias("h"))


def close(a, b, limit: Threshold) -> Column:
    """Size, position and parity filters; groups of several sets have no parity bits."""
    differ = sum((F.bit_count(a(c).bitwiseXOR(b(c))) for c in SKETCH), F.lit(0))
    return limit.sizes(a("n"), b("n")) & limit.positions(a("n"), a("place"), b("n"), b("place")) & F.coalesce(limit.parities(a("n"), b("n"), differ), F.lit(True))


def finely_close(a, b, limit: Threshold) -> Column:
    """The filter of the FINE parities, which is nearly exact for sets of some hundred hashes: 256 bits let many unlike pairs pass there."""
    differ = F.aggregate(F.zip_with(a("fine"), b("fine"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.coalesce(limit.parities(a("n"), b("n"), differ), F.lit(True))


def unlike(a, b) -> Column:
    """Not all members of both are of one component."""
    return (a("low") != b("low")) | (a("high") != b("high")) | (a("low") != a("high"))


def links(docs: DataFrame, words: int, limit: Threshold) -> tuple[DataFrame, DataFrame]:
    """(row_key, n, rep) of every document of (row_key, text), and (node, label) of linked representatives that are not their component's smallest. Representatives are the smallest keys of equal sets."""
    with passing(docs.sparkSession) as stays:
        classes, labels = _links(docs, words, limit)
        return stays(classes), stays(labels)


def _links(docs: DataFrame, words: int, limit: Threshold) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    sets, levels = measured(docs, words)
    # only copies need their representative looked up; written, so that the join deals rows anew and those of one text can be split
    reps = staged(sets.where("n > 0").groupBy("digest").agg(F.min("row_key").alias("rep"), F.count(F.lit(1)).alias("many")).where("many > 1").select("digest", "rep"), "reps")
    classes = staged(sets.join(reps, "digest", "left").select("row_key", "n", F.when(F.col("n") > 0, F.coalesce("rep", "row_key")).alias("rep")), "classes")
    own = classes.where("row_key = rep").select("row_key")
    # the few rows beyond own that the bit set lets pass are copies, which link with what they copy
    prefixed = staged(prefixes(docs, own, words, limit, levels), "prefixes")
    copies = classes.where("rep IS NOT NULL").groupBy(F.col("rep").alias("key")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    anchored = prefixed.select("anchors", F.col("row_key").alias("key"), "n").join(copies.hint("merge"), "key", "left").select(F.explode("anchors").alias("token"), "key", "n", F.coalesce("copies", F.lit(1)).alias("copies"))
    anchored = staged(anchored, "anchored")  # each round reads it twice
    found: DataFrame | None = None
    labels: DataFrame | None = None
    for turn in range(ROUNDS):
        with passing(spark) as stays:
            more = stays(verified(led(anchored, labels, turn, limit), prefixed, docs, words, limit))
            if labels is None or not more.isEmpty():
                found = more if found is None else found.unionByName(more)
                labels = stays(stars(found))
    # groups of one prefix and size, and the components of their members
    marked = prefixed.select("row_key", F.xxhash64("prefix", "n").alias("mark"))
    shared_marks = marked.groupBy("mark").agg(F.count(F.lit(1)).alias("k"), F.min("row_key").alias("gid")).where("k > 1").select("mark", "gid")
    of_group = staged(marked.join(shared_marks, "mark").select("gid", F.col("row_key").alias("member")), "groups")
    state = prefixed.select("row_key", "n", "fine", *SKETCH).join(of_group.select("gid", F.col("member").alias("row_key")), "row_key", "left").join(labels, F.col("row_key") == labels["node"], "left")
    state = staged(state.select("row_key", "gid", "n", F.when(F.col("gid").isNotNull(), F.col("fine")).alias("fine"), *SKETCH, F.coalesce("label", "row_key").alias("label")), "states")
    groups = state.groupBy(F.coalesce("gid", "row_key").alias("gid")).agg(F.min("label").alias("low"), F.max("label").alias("high"), *(F.when(F.count(F.lit(1)) == 1, F.min(c)).alias(c) for c in SKETCH))
    groups = staged(groups, "components")
    # tokens in more than one prefix, then those in groups of different components
    often = tokens_of(prefixed).groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token")
    shared = bit_set(often)
    with passing(spark) as stays:
        tokens = tokens_of(prefixed, shared).join(groups.select("gid", "low", "high").hint("merge"), "gid")
        tokens = staged(tokens, "tokens")
        mixed = staged(tokens.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h"), F.count(F.lit(1)).alias("many")).where("l <> h").select("token", "many"), "mixed")
        # open rows carry the parity bits, so that pairs are made only where these agree
        tokens = stays(staged(tokens.join(mixed.hint("merge"), "token").join(groups.select("gid", *SKETCH).hint("merge"), "gid"), "open"))
    few = tokens.where(F.col("many") <= SMALL)
    l, r = few.alias("l"), few.alias("r")
    a, b = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    met = l.join(r, (a("token") == b("token")) & (a("gid") < b("gid")) & unlike(a, b) & close(a, b, limit)).select(a("gid").alias("g"), b("gid").alias("h"))
    large = tokens.where(F.col("many") > SMALL).join(kept_tokens(prefixed, shared).hint("merge"), "gid")
    # a group of several sets has null sketches and no fine parities either
    fine = prefixed.where("fine IS NOT NULL").select(F.col("row_key").alias("gid"), "fine")
    large = large.join(fine.hint("merge"), "gid", "left").select(F.col("token").alias("bucket"), F.col("gid").alias("key"), "n", "place", "low", "high", "kept", F.when(F.col("s0").isNotNull(), F.col("fine")).alias("fine"), *SKETCH)
    met = met.unionByName(crossing(large, limit)).distinct()
    # expansion to members: only groups of more than one need it
    left = of_group.select(F.col("gid").alias("g"), F.col("member").alias("a0"))
    right = of_group.select(F.col("gid").alias("h"), F.col("member").alias("b0"))
    expanded = met.join(left, "g", "left").join(right, "h", "left").select(F.coalesce("a0", "g").alias("a0"), F.coalesce("b0", "h").alias("b0"))
    apart = groups.where("low <> high").select("gid")
    members = state.where("gid IS NOT NULL").join(apart, "gid").select(F.col("gid").alias("bucket"), F.col("row_key").alias("key"), "n", F.lit(0).alias("place"), F.col("label").alias("low"), F.col("label").alias("high"), F.array("gid").alias("kept"), "fine", *SKETCH)
    within = crossing(members, limit).select(F.col("g").alias("a0"), F.col("h").alias("b0"))
    pairs = staged(expanded.unionByName(within).select(*_pair("a0", "b0")).distinct(), "pairs")
    names = state.select("row_key", "label")
    parted = pairs.join(names.select(F.col("row_key").alias("a"), F.col("label").alias("la")), "a").join(names.select(F.col("row_key").alias("b"), F.col("label").alias("lb")), "b").where("la <> lb").select("a", "b")
    more = verified(parted, prefixed, docs, words, limit)
    return classes, labels if more.isEmpty() else stars(found.unionByName(more))


def similar_documents(docs: DataFrame, words: int = 5, p: int = 80, q: int = 100, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest id reachable by links, the document's own included."""
    keyed = row_keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), "text"))
    classes, labels = links(keyed.select("row_key", "text"), words, Threshold(p, q))
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select("row_key", "n", F.coalesce("label", "rep", "row_key").alias("component"))
    if by_id(keyed):  # the smallest row key of a component is its smallest id
        return named.select(F.col("row_key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    named = named.join(keyed.select("row_key", "doc_id"), "row_key")
    # written, so that the join deals rows anew and those of one component can be split
    least = staged(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    return named.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, words: int = 5, p: int = 80, q: int = 100, id_col: str = "doc_id") -> DataFrame:
    """docs with one document of each component: the one of the smallest id. Documents without shingles all stay."""
    docs, restored = set_aside(docs, "row_key")
    keyed = row_keyed(docs, id_col)
    classes, labels = links(keyed.select("row_key", "text"), words, Threshold(p, q))
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select("row_key", F.coalesce("label", "rep", "row_key").alias("component"))
    kept = named.groupBy("component").agg(F.min("row_key").alias("row_key")).select("row_key")
    return restored(keyed.join(kept.hint("merge"), "row_key", "left_semi").drop("row_key"))
