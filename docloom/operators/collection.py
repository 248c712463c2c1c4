"""A stored collection of vectors in coarse cells, and exact nearest vectors that skip cells.

Each vector lies in the cell of its nearest centre; a cell knows its radius. A query's distance to any vector of a cell is at
least its distance to the centre less the radius, so a cell farther away than the k-th best distance found so far can't hold a better one.
A query first reads its nearest cells, enough of them to hold k vectors; what these give bounds the k-th distance, and only cells
within the bound are read then.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docloom.operators.blocks import top_of_block
from docloom.session import settled

#: Vectors from which centres are drawn, rounds that move them, and vectors in a block and queries in one.
SAMPLE, ROUNDS, ROWS, QUERY_ROWS = 4096, 5, 4096, 256
#: Distances are of float32 components: bounds are widened by so much of them.
SLACK = 1e-5


def centres_of(points: np.ndarray, cells: int) -> np.ndarray:
    """Centres of a bounded sample: farthest first, then a few rounds of means."""
    chosen = [0]
    away = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(cells, len(points)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    centres = points[chosen].astype(float)
    for _ in range(ROUNDS):
        near = distances(points, centres).argmin(axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = points[near == c].mean(axis=0)
    return centres


def distances(X: np.ndarray, Y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (X * X).sum(axis=1)[:, None] - 2 * X @ Y.T + (Y * Y).sum(axis=1)))


def _usable(vectors: DataFrame, id_col: str, vector_col: str, dims: int | None = None) -> DataFrame:
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & (F.size("vector") > 0) & finite)
    return rows if dims is None else rows.where(F.size("vector") == dims)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def write_collection(vectors: DataFrame, root: str, cells: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
    """Blocks of vectors by cell at root/blocks and the cells (cell, centre, radius, n) at root/cells. Vectors that are null, empty, of another length than the sample's first or hold null or non-finite components are left out."""
    rows = _usable(vectors, id_col, vector_col)
    drawn = [r["vector"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    dims = len(drawn[0]) if drawn else 1
    rows = rows.where(F.size("vector") == dims)
    points = np.array([v for v in drawn if len(v) == dims]).reshape(-1, dims)
    n = rows.count()
    centres = centres_of(points, cells or max(1, min(1024, math.isqrt(n)))) if len(points) else np.zeros((0, dims))
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # at most SAMPLE of them

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = distances(_matrix(batch.column("vector")), shared.value)
                cell = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(cell, pa.int32()), pa.array(away[np.arange(len(cell)), cell])], ["id", "vector", "cell", "away"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(cell)) + 1):
                if len(part):
                    its = batch.slice(int(part[0]), len(part))
                    yield pa.RecordBatch.from_pydict({"cell": pa.array([int(cell[part[0]])], pa.int32()), "n": pa.array([len(part)], pa.int32()), "ids": [np.asarray(its.column("id"), "<i8").tobytes()], "matrix": [_matrix(its.column("vector")).astype("<f4").tobytes()]})

    own = settled(rows.mapInArrow(placed, "id long, vector array<double>, cell int, away double"), "placed")
    own.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").mapInArrow(packed, "cell int, n int, ids binary, matrix binary").write.parquet(f"{root}/blocks")
    middle = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    own.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).join(F.broadcast(middle), "cell").write.parquet(f"{root}/cells")


def _asked(queries: DataFrame, cells: list, k: int, bounds: bool) -> DataFrame:
    """(cell, query, vector[, bound]): the cells a query reads; without bounds its nearest ones that hold k vectors, with bounds those within, less the ones it has read."""
    centres, radius, n = np.array([c["centre"] for c in cells]), np.array([c["radius"] for c in cells]), np.array([c["n"] for c in cells])
    names = np.array([c["cell"] for c in cells])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away = distances(_matrix(batch.column("vector")), centres)
            order = np.argsort(away, axis=1, kind="stable")
            held = np.cumsum(n[order], axis=1)
            first = held - n[order] < k  # enough cells to hold k vectors
            read = np.zeros(away.shape, bool)
            np.put_along_axis(read, order, first, 1)
            if bounds:
                bound = batch.column("bound").to_numpy(zero_copy_only=False)[:, None]
                read = ~read & (away - radius <= bound + SLACK * (1 + away + radius))
            q, c = np.nonzero(read)
            yield pa.RecordBatch.from_arrays([pa.array(names[c], pa.int32()), batch.column("query").take(pa.array(q)), batch.column("vector").take(pa.array(q))], ["cell", "query", "vector"])

    return queries.mapInArrow(run, "cell int, query long, vector array<double>")


def _best(asked: DataFrame, blocks: DataFrame, k: int, digits: int) -> DataFrame:
    """(query, doc, score) of at least the k best vectors of each query in each cell it reads."""
    deal = F.pmod(F.xxhash64("query"), F.lit(64)).alias("deal")
    grouped = asked.groupBy("cell", deal).agg(F.collect_list("query").alias("queries"), F.collect_list("vector").alias("vectors"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, matrix = (batch.column(c)[row].as_py() for c in ("ids", "matrix"))
                ids = np.frombuffer(ids, "<i8")
                X = np.frombuffer(matrix, "<f4").reshape(len(ids), -1)
                queries = batch.column("queries")[row].as_py()
                Q = np.array(batch.column("vectors")[row].as_py()).astype(np.float32)
                for a, q in zip(queries, Q, strict=True):
                    score = np.round(((X - q) ** 2).sum(axis=1, dtype=float), digits)
                    top = top_of_block(score, ids, k)
                    yield pa.RecordBatch.from_pydict({"query": pa.array([a] * len(top), pa.int64()), "doc": pa.array(ids[top]), "score": pa.array(score[top])})

    return blocks.join(grouped, "cell").select("ids", "matrix", "queries", "vectors").mapInArrow(run, "query long, doc long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query").orderBy("score", "doc")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_collection(spark: SparkSession, root: str, queries: DataFrame, k: int, digits: int = 9, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, float]:
    """(query, doc, score, rank) of the k nearest vectors by the sum of squared float32 differences, ties to the smaller id, exactly; and the share of (query, cell) pairs read."""
    cells = spark.read.parquet(f"{root}/cells").orderBy("cell").collect()  # at most SAMPLE
    if not cells:
        return spark.createDataFrame([], "query long, doc long, score double, rank int"), 0.0
    blocks = spark.read.parquet(f"{root}/blocks")
    asking = _usable(queries, id_col, vector_col, len(cells[0]["centre"])).groupBy("id").agg(F.min("vector").alias("vector")).select(F.col("id").alias("query"), "vector")
    first = settled(_asked(asking, cells, k, False), "asked")
    near = settled(_best(first, blocks, k, digits), "near")
    bound = _top(near, k).groupBy("query").agg(F.max(F.sqrt("score")).alias("bound"), F.count(F.lit(1)).alias("n")).select("query", F.when(F.col("n") >= k, F.col("bound")).otherwise(float("inf")).alias("bound"))
    rest = settled(_asked(asking.join(bound, "query"), cells, k, True), "asked")
    found = _top(near.unionByName(_best(rest, blocks, k, digits)), k)
    read = (first.count() + rest.count()) / max(1, asking.count() * len(cells))
    return found, read
