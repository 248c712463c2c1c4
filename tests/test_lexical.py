"""Top documents from blocks, against every posting scored."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import lexical
from docloom.sources import writers


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    text = lambda n: " ".join(draw.choices(words, weights, k=n))
    rows = [(i, text(draw.choice([0, 3, 20, 200])) if i % 50 else None) for i in range(900)] + [(1000 + i, "w7 w8 w9") for i in range(40)]  # ties
    docs = spark.createDataFrame(rows, "id long, text string").cache()
    queries = spark.createDataFrame([(f"q{i}", text(draw.choice([1, 6, 30]))) for i in range(40)] + [("none", "zzz"), ("empty", "")], "query string, text string")
    tokens = lexical.ascii_tokens(F.col("text"))
    return docs, tokens, lexical.query_terms(queries, "query", tokens).cache()


def rows_of(df):
    return sorted((r["query"], r["rank"], r["doc"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("full_text", [False, True])
def test_blocks_give_the_same_documents(spark, corpus, tmp_path, monkeypatch, full_text):
    monkeypatch.setattr(lexical, "SHARD_DOCS", 200)
    monkeypatch.setattr(lexical, "QUERIES", 16)
    docs, tokens, wanted = corpus
    index = writers.write_postings(docs, "id", tokens, f"file://{tmp_path}/x")
    assert index.members.select("shard").distinct().count() > 3
    every = (lexical.full_text_bm25 if full_text else lexical.bm25)(index, wanted)
    for k in (1, 10, 2000):
        assert rows_of(lexical.best_documents(index, wanted, k, full_text)) == rows_of(lexical.top_k(every, k))
    some = docs.where("id % 3 = 0").select(F.col("id").alias("doc"))
    assert rows_of(lexical.best_documents(index, wanted, 7, full_text, only=some)) == rows_of(lexical.top_k(every.join(some, "doc", "left_semi"), 7))
    assert lexical.best_documents(index, wanted.limit(0), 5).count() == 0


def test_text_ids_and_no_documents(spark, tmp_path):
    tokens = lexical.ascii_tokens(F.col("text"))
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "id string, text string")
    wanted = spark.createDataFrame([(1, "x"), (1, "z")], "query int, term string")
    index = writers.write_postings(docs, "id", tokens, f"file://{tmp_path}/t")
    assert [(r["doc"], r["rank"]) for r in lexical.best_documents(index, wanted, 3).orderBy("rank").collect()] == [("c", 1), ("a", 2), ("b", 3)]
    empty = writers.write_postings(docs.limit(0), "id", tokens, f"file://{tmp_path}/e")
    assert lexical.best_documents(empty, wanted, 3).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_a_shard_keeps_its_best(seed):
    """Few documents are looked up in the blocks of frequent terms, and the best are the same."""
    draw = np.random.default_rng(seed)
    n, k = 3000, 10
    terms = []
    for df in [*draw.integers(1, 60, 6), *draw.integers(n // 3, n, 6)]:
        places = np.sort(draw.choice(n, df, replace=False))
        weights = draw.uniform(0.2, 2.2, df)
        terms.append((float(np.log(1 + (n - df + 0.5) / (df + 0.5))), places, weights, 2.3))
    score = np.zeros(n)
    for idf, places, weights, _ in terms:
        score[places] += idf * weights
    allowed = draw.random(n) < 0.9
    score[~allowed] = 0
    near, got, probed = lexical.best_in_shard(terms, allowed, k)
    want = np.lexsort((np.arange(n), -score))[:k]
    order = np.lexsort((near, -got))[:k]
    assert near[order].tolist() == want.tolist() and np.allclose(got[order], score[want])
    assert probed >= 3 and len(near) < n / 10
