"""op8: passages repeated across documents, deleted from all but the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.chunk_dedup import dedup_substrings


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs)


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLES: dict[str, str] = {}
