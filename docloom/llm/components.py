"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import collected, dropped, staged


def stars(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, label) for every node of edges (a, b) that reaches a smaller one: label is the smallest node reached.

    Each step joins edges to each node's smallest neighbour; no node's neighbours are gathered.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        last, now = now, staged(small, "edges")
        dropped(last)
        mark = collected(now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))))[0]
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node reached. Rows of nodes without edges are not made."""
    found = stars(edges, most)
    return found.unionByName(found.select(F.col("label").alias("node"), "label").distinct())
