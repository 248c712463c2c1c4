"""Exact vector scoring: measures as column expressions, and the nearest vectors of a query set by blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.blocks import search, top_of_block


def squared_l2(a: Column, b: Column) -> Column:
    """Sum of squared float32 differences, accumulated in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, a_norm: Column | None = None) -> Column:
    """0 where a norm is 0."""
    scale = (norm(a) if a_norm is None else a_norm) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(scale != 0, scale))


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, measure: str = "l2", digits: int = 9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query, doc, score, rank): the k best vectors of each query, exactly. ``measure``: l2, the sum of squared float32 differences, or cosine.

    Queries and vectors are packed into blocks; a task holds one block against one other, with the norms of both computed
    once, and hands on the best k of each query in the block. No row is made of a pair that isn't among these.
    """

    def best(ids: np.ndarray, X: np.ndarray, qids: np.ndarray, Q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if measure == "cosine":
            scale = np.sqrt((Q * Q).sum(axis=1))[:, None] * np.sqrt((X * X).sum(axis=1))
            every = np.divide(Q @ X.T, scale, out=np.zeros(scale.shape), where=scale != 0)
        out = []
        X = X.astype(np.float32)
        for i, q in enumerate(Q.astype(np.float32)):
            score = np.round(every[i] if measure == "cosine" else ((X - q) ** 2).sum(axis=1, dtype=float), digits)
            top = top_of_block(-score if measure == "cosine" else score, ids, k)
            out.append((np.full(len(top), i), top, score[top]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    found = search(vectors, queries, k, best, "double", measure != "cosine", id_col, vector_col)
    return found.select(F.col("query_id").alias("query"), F.col("vec_id").alias("doc"), "score", "rank")
