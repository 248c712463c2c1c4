import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docloom.llm import ann, maxscore
from docloom.llm.maxscore import block_top
from docloom.llm.q_vectors import op2_ann, op6_topk
from docloom.operators import blocks

SF = "/root/testdata/sf0.01"


def brute(ids, X, qids, Q, k, distance: bool):
    out = {}
    for i, q in zip(qids, Q, strict=True):
        score = np.sqrt(((X - q) ** 2).sum(axis=1)) if distance else -(X @ q)
        order = [j for j in np.lexsort((ids, score)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_ann_recall(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    ids, X = t["vec_id"].to_numpy(), np.stack(t["embedding"].to_pylist()).astype(np.float32).astype(float)
    asked = ids % 100 == 0
    want = brute(ids, X, ids[asked], X[asked], 10, True)
    got: dict = {}
    for r in op2_ann(spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = sum(len({v for v, _ in want[q]} & {v for v, _ in got.get(q, [])}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    by_id = dict(zip(ids.tolist(), X, strict=True))
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (x[1], x[0]))
        for v, score in found:
            assert abs(score - np.linalg.norm(by_id[v] - by_id[q])) < 1e-9


def recall(spark, X, asked, k=10, **settings):
    """Share of the k nearest found, and how many each query has."""
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.nearest(rows, rows.where(F.col("vec_id").isin(asked)), k=k, **settings).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    ids = np.arange(len(X))
    want = brute(ids, X, np.array(asked), X[asked], k, True)
    return sum(len({v for v, _ in want[q]} & got.get(q, set())) for q in asked) / (k * len(asked)), {len(got.get(q, ())) for q in asked}


@pytest.mark.parametrize(("scale", "shift"), [(1, 0), (10, 0), (0.01, 0), (1, 30)])
def test_recall_for_any_scale_and_several_blocks(spark, monkeypatch, scale, shift):
    monkeypatch.setattr(blocks, "ROWS", 300)
    monkeypatch.setattr(blocks, "QUERY_ROWS", 7)
    draw = np.random.default_rng(3)
    X = draw.standard_normal((1500, 32))
    X = scale * (X / np.linalg.norm(X, axis=1, keepdims=True) + shift)
    share, found = recall(spark, X, list(range(0, 1500, 100)))
    assert share >= 0.9 and found == {10}


def test_recall_of_mixed_lengths_and_far_queries(spark):
    draw = np.random.default_rng(4)
    X = draw.standard_normal((800, 16)) * draw.choice([0.1, 1, 10], 800)[:, None]
    X[0] = 1e6
    share, found = recall(spark, X, [0, *range(100, 800, 50)])
    assert share >= 0.9 and found == {10}
    few, found = recall(spark, X, [0, 100], probes=1)  # buckets of one probe are mostly empty: all of the block are met
    assert found == {10}


def test_op6_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 64)
    monkeypatch.setattr(blocks, "QUERY_ROWS", 3)
    test_op6_is_exact(spark)


ODD = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0]), (8, [1.0, 2.5]), (9, [1.0]), (50, [-1.0, -2.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0])]


def test_odd_vectors(spark):
    rows = spark.createDataFrame([(*r, "x", 1) for r in ODD], "vec_id long, embedding array<double>, score string, rank int")
    near = ann.nearest(rows, rows.where("vec_id in (0, 3, 9)"), k=3)
    assert near.columns == ["query_id", "rank", "vec_id", "score"]
    got = [tuple(r) for r in near.orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 0.0), (0, 2, 7, 0.0), (0, 3, 8, 0.5)]
    top = maxscore.top_k(rows, rows.where("vec_id in (0, 3, 9, 50)"), k=2)
    got = [tuple(r) for r in top.orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 8, 256 * 256 + 512 * 640), (0, 2, 7, 256 * 256 + 512 * 512), (3, 1, 0, 0), (3, 2, 7, 0), (50, 1, 3, 0), (50, 2, 0, -(256 * 256 + 512 * 512))]
    assert ann.nearest(rows.limit(0), rows.limit(0)).count() == 0
    assert maxscore.top_k(rows.limit(0), rows.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_maxscore_block(seed):
    draw = np.random.default_rng(seed)
    n, d = int(draw.integers(1, 300)), int(draw.integers(1, 70))
    D = np.floor(draw.standard_normal((n, d)) * draw.choice([1, 40, 256]))
    if seed % 3 == 0:
        D = np.abs(D)
    if seed % 4 == 0:
        D[: n // 2] = D[0]
    ids = draw.permutation(10 * n)[:n]
    m = min(n, 7)
    q, v, s = block_top(ids, D, ids[:m], D[:m], 5)
    want = brute(ids, D, ids[:m], D[:m], 5, False)
    for j in range(m):
        got = [(int(ids[b]), -int(c)) for a, b, c in zip(q, v, s, strict=True) if a == j]
        assert got == [(i, int(x)) for i, x in want[int(ids[j])]]


def test_op6_is_exact(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    ids, X = t["vec_id"].to_numpy(), np.floor(256 * np.stack(t["embedding"].to_pylist()).astype(np.float32).astype(float))
    asked = ids % 50 == 0
    want = brute(ids, X, ids[asked], X[asked], 5, False)
    got: dict = {}
    for r in op6_topk(spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], -float(r["score"])))
    assert got == want


def cells(df) -> int:
    """Cells that a plan without a join deals blocks to: there is a copy of a query block for each shard."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    return int(re.search(r"RepartitionByExpression \[direct_shuffle_partition_id\(cell#\d+\)\], (\d+)", plan)[1])


@pytest.mark.parametrize("name", ["ann", "maxscore"])
def test_copies_of_queries_are_not_broadcast_nor_as_many_as_blocks(spark, monkeypatch, name):
    monkeypatch.setattr(blocks, "ROWS", 10)
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1000)], "vec_id long, embedding array<double>")
    found = {"ann": ann.nearest, "maxscore": maxscore.top_k}[name](rows, rows.where("vec_id % 50 = 0"), k=3)
    assert cells(found) <= blocks.SHARDS * spark.sparkContext.defaultParallelism < 100
    assert found.count() == 60


def test_tasks_that_hold_parts_of_the_queries(spark, monkeypatch):
    for name, value in (("ROWS", 30), ("QUERY_ROWS", 4), ("QUERY_BLOCKS", 2)):
        monkeypatch.setattr(blocks, name, value)
    test_op6_is_exact(spark)


def test_a_shard_just_above_the_size_of_a_block_is_one(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1000)], "vec_id long, embedding array<double>").repartition(4)
    monkeypatch.setattr(blocks, "ROWS", 120)
    monkeypatch.setattr(blocks, "SHARDS", 2)
    count = spark.sparkContext.accumulator(0)

    def best(ids, X, qids, Q):
        count.add(1)
        return np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1)

    got = blocks.search(rows, rows.where("vec_id = 0"), 1, best, "double", True)
    assert got.count() == 1 and count.value == cells(got) == 8
