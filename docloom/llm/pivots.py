"""Hard negatives of anchors by inner product, found with a pivot table.

A vector x with squared norm n becomes the point (x, sqrt(M - n)), M being the largest squared norm of all; an anchor q
becomes (q, 0). The squared distance of the two is M + |q|^2 - 2 qx, so the largest inner products are the smallest
distances. The pivot table holds each point's distances to ``PIVOTS`` points, chosen farthest first from a sample of
``SAMPLE`` vectors. By the triangle inequality an anchor's and a vector's distances to a pivot bracket their own distance,
hence their score; only pairs whose bracket reaches into the range that is still wanted are multiplied out.

Two passes over the stored table: each anchor's best vectors of its own label (its positives), then, for each of these,
the best vectors of other labels whose score lies between two shares of the positive's. Anchor blocks are dealt to shards
of table blocks; a task keeps its running best rows of an anchor, whose last score narrows what is wanted of later blocks.

Defined cases: rows with a null id, a null label, a null or empty vector, or null or non-finite components take no part; vectors of
another length than the anchor's are no candidates; several anchor rows of one id: the least (label, vector) asks; repeated
candidate rows each take a place; ties go to the smaller id; an anchor without another row of its label gives no rows,
nor does a positive without a vector in its range (any of negative score has none); labels are whole numbers; sums of products are exact below
2**53; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docloom.llm.common import staged

PIVOTS, SAMPLE = 16, 1024
#: Vectors and anchors in a block, and blocks of a shard once there are enough shards for all cores.
ROWS, ANCHOR_ROWS, SHARD_BLOCKS = 4096, 256, 16
#: Anchors whose best rows a task holds before it hands them on.
HELD = 20_000
_TABLE = "dims int, ids binary, labels binary, matrix binary, distances binary"


def taking_part(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, vector) of the rows that take part."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    return named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & finite)


def quantized(X: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * X)


def farthest_first(points: np.ndarray, k: int) -> np.ndarray:
    """k of the points (all, if fewer), each the farthest from those before it."""
    if not len(points):
        return points
    chosen = [0]
    away = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(points)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def fitted(pivots: np.ndarray, dims: int) -> np.ndarray:
    """The pivots as points of ``dims`` components: any point serves as a pivot, so they are cut or filled with noughts."""
    out = np.zeros((len(pivots), dims))
    out[:, : min(dims, pivots.shape[1])] = pivots[:, :dims]
    return out


def distances(X: np.ndarray, lift: np.ndarray, pivots: np.ndarray, top: float) -> np.ndarray:
    """(pivots, rows) float32: distances of the points (x, lift) to the pivots, each lifted like a vector."""
    P = fitted(pivots, X.shape[1])
    norms = (P * P).sum(axis=1)
    high = np.sqrt(np.maximum(0, top - norms))
    squared = norms[:, None] + (X * X).sum(axis=1) - 2 * P @ X.T + (high[:, None] - lift) ** 2
    return np.sqrt(np.maximum(0, squared)).astype(np.float32)


def brackets(near: np.ndarray, far: np.ndarray, Q: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """(least, most): what the score of each (anchor, vector) can be, from their distances to the pivots (pivots, rows), widened by the rounding of float32."""
    closest = np.zeros((near.shape[1], far.shape[1]), np.float32)
    widest = np.full(closest.shape, np.inf, np.float32)
    work = np.empty_like(closest)
    for q, x in zip(near, far, strict=True):
        np.subtract(q[:, None], x, out=work)
        np.abs(work, out=work)
        np.maximum(closest, work, out=closest)
        np.add(q[:, None], x, out=work)
        np.minimum(widest, work, out=widest)
    total = (top + (Q * Q).sum(axis=1))[:, None]
    slack = 2e-6 * total
    return (total - widest.astype(float) ** 2) / 2 - slack, (total - closest.astype(float) ** 2) / 2 + slack


def scores(Q: np.ndarray, D: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The inner products of the wanted pairs, -inf elsewhere; by gathering where few are wanted."""
    out = np.full(wanted.shape, -np.inf)
    if wanted.mean() > 0.05:
        np.copyto(out, Q @ D.T, where=wanted)
    else:
        q, d = np.nonzero(wanted)
        out[q, d] = np.einsum("ij,ij->i", Q[q], D[d])
    return out


def block_rows(ids, labels, D, far, qids, qlabels, Q, near, low, high, top: float, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor place, slot, vector place, score) of the pairs whose score lies in one of the anchor's ranges low..high (anchors, slots), at least the k best of each slot in the block.

    ``same``: whether vectors have the anchor's label. Slots without a range are NaN.
    """
    allowed = (labels == qlabels[:, None]) == same
    allowed &= ids != qids[:, None]
    least, most = brackets(near, far, Q, top)
    some = ~np.isnan(low).all(axis=1)
    floor = np.where(some, np.nanmin(np.where(np.isnan(low), np.inf, low), axis=1), np.inf)
    ceiling = np.where(some, np.nanmax(np.where(np.isnan(high), -np.inf, high), axis=1), -np.inf)
    allowed &= (most >= floor[:, None]) & (least <= ceiling[:, None])
    score = scores(Q, D, allowed)
    out = []
    for slot in range(low.shape[1]):
        fit = allowed & (score >= low[:, slot, None]) & (score <= high[:, slot, None])
        q, d = np.nonzero(fit)
        s = score[q, d]
        order = np.lexsort((ids[d], -s, q))
        q, d, s = q[order], d[order], s[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < k
        out.append((q[best], np.full(best.sum(), slot), d[best], s[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class PivotTable:
    """The stored table of blocks with their distances to the pivots, and what the search needs of all vectors."""

    def __init__(self, rows: DataFrame, scale: int = 256, pivots: int = PIVOTS, sample: int = SAMPLE):
        self.scale, self.spark = scale, rows.sparkSession
        whole = F.transform("vector", lambda x: F.floor(scale * x).cast("double"))
        norm = F.aggregate(whole, F.lit(0.0), lambda s, x: s + x * x)
        n, top = rows.agg(F.count(F.lit(1)), F.max(norm)).first()
        self.n, self.top = n, float(top or 0)
        blocks = math.ceil(n / ROWS)
        self.shards = max(1, min(blocks, max(2 * self.spark.sparkContext.defaultParallelism, math.ceil(blocks / SHARD_BLOCKS))))
        drawn = [r[0] for r in rows.orderBy(F.xxhash64("id", "vector"), "id", "vector").limit(sample).select("vector").collect()]
        width = max(map(len, drawn), default=1)
        points = np.zeros((len(drawn), width))
        for i, v in enumerate(drawn):
            points[i, : len(v)] = quantized(np.array(v), scale)
        lift = np.sqrt(np.maximum(0, self.top - (points * points).sum(axis=1)))
        self.pivots = farthest_first(np.hstack([points, lift[:, None]]), pivots)[:, :-1]
        self.table = staged(self._packed(rows.repartition(self.shards), ROWS, True).withColumn("shard", F.spark_partition_id()), "pivots")

    def _packed(self, rows: DataFrame, most: int, lifted: bool, slots: int = 0) -> DataFrame:
        """Blocks of (id, label, vector[, low, high]) with their distances to the pivots; anchors aren't lifted."""
        scale, pivots, top = self.scale, self.pivots, self.top

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}

            def block(dims: int) -> pa.RecordBatch:
                got = held.pop(dims)
                X = quantized(np.stack([x[2] for x in got]), scale)
                lift = np.sqrt(np.maximum(0, top - (X * X).sum(axis=1))) if lifted else np.zeros(len(X))
                one = {"dims": pa.array([dims], pa.int32()), "ids": [np.array([x[0] for x in got], "<i8").tobytes()], "labels": [np.array([x[1] for x in got], "<i8").tobytes()], "matrix": [X.astype("<f8").tobytes()], "distances": [distances(X, lift, pivots, top).tobytes()]}
                if slots:
                    one |= {"ranges": [np.array([x[3] for x in got], "<f8").tobytes()]}
                return pa.RecordBatch.from_pydict(one)

            for batch in batches:
                extra = batch.column(3).to_pylist() if slots else [None] * batch.num_rows
                for i, label, v, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), extra, strict=True):
                    x = v.values.to_numpy(zero_copy_only=False)
                    held.setdefault(len(x), []).append((i, label, x, r))
                    if len(held[len(x)]) >= most:
                        yield block(len(x))
            for dims in sorted(held):
                yield block(dims)

        return rows.mapInArrow(run, _TABLE + ", ranges binary" * bool(slots))

    def best(self, anchors: DataFrame, slots: int, same: bool, k: int) -> DataFrame:
        """(anchor, slot, vec_id, score, rank): the k best vectors of each anchor's slots. anchors: (id, label, vector, ranges), the last holding low and high of each slot, NaN where there is none."""
        m = anchors.count()
        asked = self._packed(anchors.repartition(max(1, math.ceil(m / ANCHOR_ROWS))), ANCHOR_ROWS, False, slots)
        asked = asked.select("dims", *(F.col(c).alias(f"q_{c}") for c in ("ids", "labels", "matrix", "distances", "ranges")), F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1))).alias("shard"))
        pivots, top = len(self.pivots), self.top

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

            def given() -> pa.RecordBatch:
                rows = [(q, s, i, x) for (q, s), (its, got) in held.items() for i, x in zip(its.tolist(), got.tolist(), strict=True)]
                held.clear()
                q, s, i, x = zip(*rows, strict=True) if rows else ((), (), (), ())
                return pa.RecordBatch.from_pydict({"anchor": pa.array(q, pa.int64()), "slot": pa.array(s, pa.int32()), "vec_id": pa.array(i, pa.int64()), "score": pa.array([int(v) for v in x], pa.int64())})

            for batch in batches:
                for row in range(batch.num_rows):
                    dims, *parts = (batch.column(c)[row].as_py() for c in range(10))
                    ids, labels, D, far, qids, qlabels, Q, near, ranges = (np.frombuffer(p, t) for p, t in zip(parts, ("<i8", "<i8", "<f8", "<f4", "<i8", "<i8", "<f8", "<f4", "<f8"), strict=True))
                    low, high = np.moveaxis(ranges.reshape(len(qids), slots, 2).copy(), 2, 0)
                    for i, q in enumerate(qids.tolist()):  # what the task has found already raises the bar
                        for s in range(slots):
                            if (known := held.get((q, s))) and len(known[0]) >= k:
                                low[i, s] = max(low[i, s], known[1][-1])
                    q, s, d, x = block_rows(ids, labels, D.reshape(-1, dims), far.reshape(pivots, -1), qids, qlabels, Q.reshape(-1, dims), near.reshape(pivots, -1), low, high, top, same, k)
                    order = np.lexsort((s, q))
                    q, s, d, x = q[order], s[order], d[order], x[order]
                    edges = [*(np.flatnonzero((np.diff(q) != 0) | (np.diff(s) != 0)) + 1), len(q)]
                    at = 0
                    for end in edges:
                        if end > at:
                            key = (int(qids[q[at]]), int(s[at]))
                            its, got = ids[d[at:end]], x[at:end]
                            if key in held:
                                its, got = np.concatenate([held[key][0], its]), np.concatenate([held[key][1], got])
                            top_k = np.lexsort((its, -got))[:k]
                            held[key] = its[top_k], got[top_k]
                            at = end
                    if len(held) > HELD:
                        yield given()
            yield given()

        # not broadcast: Spark would judge the copies of the anchors by the size of one
        joined = self.table.join(asked.hint("merge"), ["dims", "shard"]).select("dims", "ids", "labels", "matrix", "distances", "q_ids", "q_labels", "q_matrix", "q_distances", "q_ranges")
        found = joined.mapInArrow(run, "anchor long, slot int, vec_id long, score long")
        order = W.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", **table: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its best positives the best negatives scoring from ``least`` to ``most`` hundredths of the positive."""
    rows = taking_part(vectors, id_col, label_col, vector_col)
    pivots = PivotTable(rows, scale, **table)
    asking = taking_part(anchors, id_col, label_col, vector_col).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("_a")).select("id", "_a.label", "_a.vector")
    everything = F.array(F.lit(float("-inf")), F.lit(float("inf")))
    found = staged(pivots.best(asking.withColumn("ranges", everything), 1, True, positives).select("anchor", F.col("rank").alias("slot"), "vec_id", "score"), "positives")
    # the slots of one anchor, at most ``positives``
    own = found.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("_s"))
    nan = F.lit(float("nan"))
    # 100 n >= least p and 100 n <= most p in whole numbers
    low = lambda p: F.ceil(p * least / F.lit(100)).cast("double")
    high = lambda p: F.floor(p * most / F.lit(100)).cast("double")
    ranges = F.concat(*(F.array(F.coalesce(low(F.col("_s")[i]), nan), F.coalesce(high(F.col("_s")[i]), nan)) for i in range(1, positives + 1)))
    ranged = asking.join(own, asking["id"] == own["anchor"]).select("id", "label", "vector", ranges.alias("ranges"))
    mined = pivots.best(ranged, positives, False, negatives).withColumn("slot", F.col("slot") + 1)
    return mined.join(found.select("anchor", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor", "slot"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
