"""op9: personal data in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import pii


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["base"])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.BASE_KINDS), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"), F.size("spans").cast("long").alias("n_spans"))


QUERIES = {"op9_pii": op9_pii}
ORACLES: dict[str, str] = {}
