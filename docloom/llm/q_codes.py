"""op13: every embedding as four codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import lloyd


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = lloyd.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    return codes.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(lloyd.digest(books)).alias("codebooks_sha256"))


def _round(i: int) -> str:
    """Assignments a{i} to the entries c{i}, and the entries c{i+1} after them."""
    return f"""
d{i} AS (SELECT p.vec_id, p.part, c.entry, list_sum([(p.v[j] - c.v[j]) * (p.v[j] - c.v[j]) FOR j IN range(1, len(p.v) + 1)])::BIGINT AS away FROM p JOIN c{i} c ON p.part = c.part),
a{i} AS (SELECT vec_id, part, arg_min(entry, (away, entry)) AS entry, min(away) AS away FROM d{i} GROUP BY vec_id, part),
m{i} AS (SELECT part, entry, place, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM (SELECT a.part, a.entry, unnest(p.v) AS x, unnest(range(len(p.v))) AS place FROM a{i} a JOIN p USING (vec_id, part)) GROUP BY part, entry, place),
c{i + 1} AS (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT part, entry, list(x ORDER BY place) AS v FROM m{i} GROUP BY part, entry) m ON m.part = c.part AND m.entry = c.entry),"""


SQL = f"""
WITH k AS (SELECT vec_id, label, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT vec_id, part, w[part * len(w) // 4 + 1 : (part + 1) * len(w) // 4] AS v FROM k, range(4) AS r(part)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < 256),
c0 AS (SELECT p.part, f.entry, p.v FROM p JOIN f USING (vec_id)),
{"".join(map(_round, range(4)))}
d AS (SELECT p.vec_id, p.part, c.entry, list_sum([(p.v[j] - c.v[j]) * (p.v[j] - c.v[j]) FOR j IN range(1, len(p.v) + 1)])::BIGINT AS away FROM p JOIN c4 c ON p.part = c.part),
a AS (SELECT vec_id, part, arg_min(entry, (away, entry)) AS entry, min(away) AS away FROM d GROUP BY vec_id, part),
e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(away)::BIGINT AS error FROM a GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN k USING (vec_id), h
"""
QUERIES = {"op13_codes": op13_codes}
ORACLES = {"op13_codes": SQL}
