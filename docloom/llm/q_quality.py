"""op3: the quality of every document by co-trained views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import cotrain


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    model = cotrain.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotrain.score(docs, model).select("doc_id", "quality_score", "text_score", "meta_score", "keep")


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}
