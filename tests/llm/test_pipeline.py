import hashlib
import re
import struct

import corpus_pipeline as pipeline
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tests.llm.conftest import SCHEMA
from tests.llm.test_lines import brute as cut_lines
from tests.llm.test_near import brute as groups
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"
REAL = Tokenizer.from_file(path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400").cache()


def as_rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages_and_columns():
    assert [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "mixing", "bpe"]


def test_quality_keeps_clean_documents(spark, docs):
    kept = pipeline.quality(spark, docs, SF)
    assert tuple(kept.columns) == pipeline.COLUMNS
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    both = docs.join(labels, "doc_id").join(kept.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left")
    got = {r["quality"]: r["share"] for r in both.groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share")).collect()}
    assert got[1] > 0.98 and got[0] < 0.15


def test_line_dedup_against_brute_force(spark, docs):
    out = pipeline.lines(spark, docs, SF)
    assert tuple(out.columns) == pipeline.COLUMNS
    want = [(d, t) for d, _, n, _, t in cut_lines(as_rows(docs), 2) if n == 0 or re.search(r"[^\x20\x09-\x0D]", t)]
    assert as_rows(out) == sorted(want)
    assert out.where(F.length("text") != F.col("n_chars")).count() == 0


def test_near_duplicates_against_brute_force(spark, docs):
    out = pipeline.near_duplicates(spark, docs, SF)
    assert tuple(out.columns) == pipeline.COLUMNS
    assert [d for d, _ in as_rows(out)] == sorted({c for _, _, c in groups(as_rows(docs), 5, 80, 100)})


def test_mixing_counts(spark, docs):
    out = pipeline.mix(spark, docs, SF)
    assert tuple(out.columns) == pipeline.COLUMNS
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(whole[r["doc_id"]] == r["text"] for r in out.collect())


def test_tokens_decode_to_the_text(spark, docs):
    out = pipeline.tokens(spark, docs.limit(60), SF).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out:
        ids = REAL.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(REAL.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run(spark, sf):
    out = pipeline.run(spark, sf).collect()
    assert out and {"doc_id", "ids", "n_tokens"} <= set(out[0].asDict())


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES], ids=[n for n, _ in pipeline.STAGES])
def test_odd_and_empty_input(spark, sf, odd, stage):
    stage(spark, odd, sf).collect()
    assert stage(spark, spark.createDataFrame([], SCHEMA), sf).count() == 0
