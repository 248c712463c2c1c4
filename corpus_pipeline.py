"""Training corpus from raw documents: reject, cut repeated lines, keep one of each near-duplicate group, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows and rereads them.
Rows of documents: doc_id, text, lang, source, n_chars. The last stage returns token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, cotrain, line_dedup, mixing, ngram_join
from docloom.llm.common import JAVA_WORD, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = "byte_bpe_50k.json"
WEIGHTS = (5.0, 2.0, 1.0)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    model = cotrain.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotrain.score(docs, model).where("keep").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less later copies of repeated runs of lines; one of which no word is left goes."""
    cut = line_dedup.dedup_lines(docs)
    return cut.where((F.col("n_deleted") == 0) | F.col("text").rlike(JAVA_WORD)).withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs, words=5, p=80, q=100).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to source weights takes them."""
    return mixing.mixed(docs, WEIGHTS).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, packed as little-endian 32-bit integers, and the digest of what they decode to."""
    path = public_tokenizers.path(VOCABULARY)
    return bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), path).select("doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mixing", mix), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the tokenizer have no SQL counterpart; tests/llm holds the stages against brute force.
ORACLE_SQL = None
