"""op5: the documents mixed by source weights 5, 2, 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.mixing import mix

WEIGHTS = (5.0, 2.0, 1.0)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs, WEIGHTS).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5(doc_id::VARCHAR || ':17'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
      / coalesce(1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * len(regexp_extract_all(text, '[#$%&*|!]'))::DOUBLE / greatest(length(text), 1)), 1.0::DOUBLE) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3.0::DOUBLE * source_size AS cap, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT arg_min(level, cap / weight) AS held FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(cap, held * weight) END AS target FROM l, h),
e AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, target - epochs * source_size AS rest, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM e)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN ahead < rest AND ahead + size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""
QUERIES = {"op5_mixing": op5_mixing}
ORACLES = {"op5_mixing": SQL}
