"""Fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def weighted_rrf(components: dict[str, DataFrame], weights: dict[str, float], k: int = 60, digits: int = 12) -> DataFrame:
    """(query, doc, score, rank, and rank_<component>) of (query, doc, rank) lists: sum of weight / (k + rank); order by score, best component rank, document.

    A component of weight 0 adds nothing and keeps a null rank column.
    """
    used = {n: df for n, df in components.items() if weights[n] > 0}
    rows = reduce(DataFrame.unionByName, (df.select("query", "doc", F.lit(n).alias("component"), F.col("rank").alias("r"), F.lit(float(weights[n])).alias("w")) for n, df in used.items()))
    ranks = [F.min(F.when(F.col("component") == n, F.col("r"))).alias(f"rank_{n}") for n in components]
    fused = rows.groupBy("query", "doc").agg(F.round(F.sum(F.col("w") / (k + F.col("r"))), digits).alias("score"), F.min("r").alias("best"), *ranks)
    order = W.partitionBy("query").orderBy(F.col("score").desc(), "best", "doc")
    return fused.withColumn("rank", F.row_number().over(order)).drop("best")


def rrf(lists: list[DataFrame], k: int = 60, digits: int = 12) -> DataFrame:
    """(query, doc, score, rank): unweighted; order by score, document."""
    rows = reduce(DataFrame.unionByName, (df.select("query", "doc", "rank") for df in lists))
    fused = rows.groupBy("query", "doc").agg(F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), digits).alias("score"))
    return fused.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "doc")))


def minmax(scored: DataFrame) -> DataFrame:
    """Scores of each query scaled to [0, 1]; all equal: 1."""
    own = W.partitionBy("query")
    low, high = F.min("score").over(own), F.max("score").over(own)
    return scored.withColumn("score", F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / F.when(high != low, high - low)))


def alpha_fusion(keyword: DataFrame, vector: DataFrame, alpha: float, digits: int = 9) -> DataFrame:
    """(query, doc, score, rank): alpha * vector + (1 - alpha) * keyword after scaling; a missing score counts as 0."""
    a = minmax(vector).select("query", "doc", F.col("score").alias("a"))
    b = minmax(keyword).select("query", "doc", F.col("score").alias("b"))
    both = a.join(b, ["query", "doc"], "full_outer")
    fused = both.select("query", "doc", F.round(alpha * F.coalesce("a", F.lit(0.0)) + (1 - alpha) * F.coalesce("b", F.lit(0.0)), digits).alias("score"))
    return fused.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "doc")))
