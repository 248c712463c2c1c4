"""op2 and op6: nearest neighbours and exact top-k of the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import ann, maxscore


def _with_queries(spark: SparkSession, sf_dir: str, every: int) -> tuple[DataFrame, DataFrame]:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return vectors, vectors.where(F.col("vec_id") % every == 0)


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(*_with_queries(spark, sf_dir, 100), k=10)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(*_with_queries(spark, sf_dir, 50), k=5)


OP6_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_sum([q.w[i] * d.w[i] FOR i IN range(1, len(q.w) + 1)])::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND q.vec_id % 50 = 0 AND len(q.w) = len(d.w)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
QUERIES = {"op2_ann": op2_ann, "op6_topk": op6_topk}
ORACLES = {"op6_topk": OP6_SQL}
