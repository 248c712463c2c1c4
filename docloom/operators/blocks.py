"""Vectors packed into blocks, and a query set against all blocks.

A block is one row that holds up to a few thousand vectors. Blocks are dealt to a few shards a core, and a copy of
the query blocks to every shard; a task holds the query blocks and sees the vector blocks of its shard go by, so rows
of pairs are never made, and no side is broadcast: Spark would judge the copies by the size of one. What is shuffled
grows with the vectors, and with the queries times the cores; beyond so many query blocks, tasks take a part of them each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Vectors (about) and queries in a block, shards a core, and query blocks that a task holds.
ROWS, QUERY_ROWS, SHARDS, QUERY_BLOCKS = 4096, 512, 2, 128
_PACKED = "dims int, ids binary, matrix binary"


def unpack(ids: bytes, matrix: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(matrix, "<f8").reshape(-1, dims)


def pack(vectors: DataFrame, id_col: str, vector_col: str, rows: int, zeros: bool = True) -> DataFrame:
    """Blocks of (id, vector); vectors that are null, empty or hold null or non-finite components are left out, and zero vectors unless ``zeros``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dims: int) -> pa.RecordBatch:
            got = held.pop(dims)
            return pa.RecordBatch.from_pydict({"dims": pa.array([dims], pa.int32()), "ids": [np.array([x[0] for x in got], "<i8").tobytes()], "matrix": [np.stack([x[1] for x in got]).astype("<f8").tobytes()]})

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or not len(v) or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(float)
                if np.isfinite(x).all() and (zeros or x.any()):
                    held.setdefault(len(x), []).append((i, x))
                    if len(held[len(x)]) >= rows:
                        yield block(len(x))
        for dims in sorted(held):
            yield block(dims)

    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(run, _PACKED)


def search(vectors: DataFrame, queries: DataFrame, k: int, best: Callable, score_type: str, ascending: bool, id_col: str = "vec_id", vector_col: str = "embedding", zeros: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query.

    best(ids, X, query_ids, Q) gives (query place, vector place, score) arrays: at least the k best of
    each query in the block. Rows with a query's own id are no candidates. Of several query rows with one
    id the least vector is taken; repeated candidate rows each take a place.
    """
    n, m = vectors.count(), queries.count()
    asked_blocks = max(1, math.ceil(m / QUERY_ROWS))
    parts = math.ceil(asked_blocks / QUERY_BLOCKS)
    shards = max(1, min(math.ceil(n / ROWS), math.ceil(SHARDS * vectors.sparkSession.sparkContext.defaultParallelism / parts)))
    # a shard's blocks are of a size, with room for rows that are dealt unevenly: a block costs its queries the same if it is small
    rows = math.ceil(1.05 * n / (shards * max(1, round(n / (shards * ROWS))))) + 16
    cell = lambda shard, part: (shard * parts + part).cast("int").alias("cell")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_to")
    own = lambda k: F.pmod(F.spark_partition_id(), F.lit(k)).alias("_own")
    table = pack(vectors.repartition(shards), id_col, vector_col, rows, zeros).select("dims", "ids", "matrix", own(shards), every(parts)).select(cell(F.col("_own"), F.col("_to")), F.lit(1).alias("turn"), "dims", "ids", "matrix")
    asked = pack(queries.groupBy(id_col).agg(F.min(vector_col).alias(vector_col)).repartition(asked_blocks), id_col, vector_col, QUERY_ROWS, zeros)
    asked = asked.select("dims", "ids", "matrix", own(parts), every(shards)).select(cell(F.col("_to"), F.col("_own")), F.lit(0).alias("turn"), "dims", "ids", "matrix")
    arrow_score = pa.int64() if score_type == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        here = None
        for batch in batches:
            for row in range(batch.num_rows):
                at, turn, dims, ids, matrix = (batch.column(c)[row].as_py() for c in range(5))
                if at != here:
                    held, here = {}, at
                ids, X = unpack(ids, matrix, dims)
                if not turn:
                    held.setdefault(dims, []).append((ids, X))
                    continue
                for qids, Q in held.get(dims, ()):
                    qi, di, score = best(ids, X, qids, Q)
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(qids[qi]), "vec_id": pa.array(ids[di]), "score": pa.array(score, arrow_score)})

    dealt = table.unionByName(asked).repartitionById(shards * parts, "cell").sortWithinPartitions("cell", "turn")
    found = dealt.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    order = W.partitionBy("query_id").orderBy(F.col("score").asc() if ascending else F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_of_block(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest scores, ties to smaller ids."""
    if len(score) > k:
        cut = np.partition(score, k - 1)[k - 1]
        near = np.flatnonzero(score <= cut)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], score[near]))][:k]
