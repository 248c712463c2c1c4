"""op12: the toxicity of every document, learnt from four fifths of the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import toxic_cnn


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = lambda: F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out())
    return toxic_cnn.score(docs, toxic_cnn.fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op12_toxicity": op12_toxicity}
ORACLES: dict[str, str] = {}
