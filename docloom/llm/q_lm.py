"""op7: every document scored by the unigram base and the recurrent model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.gru_lm import score


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op7_lm": op7_lm}
ORACLES: dict[str, str] = {}
