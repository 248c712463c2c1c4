import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docloom.llm import pivots
from docloom.llm.pivots import PivotTable, brackets, distances, farthest_first, hard_negatives, taking_part
from docloom.llm.q_negatives import op11_hard_negatives

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, anchors, positives=5, negatives=10, least=30, most=90, scale=256):
    """Loops over all pairs of (id, label, vector) rows."""
    whole = [(i, g, [int(np.floor(scale * x)) for x in v]) for i, g, v in rows]
    out = []
    for a, label, v in whole:
        if a not in anchors:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, g) for i, g, w in whole if i != a and len(w) == len(v)]
        for p, pid, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            fit = sorted((s, i) for s, i, g in scored if g != label and -least * p <= -100 * s <= -most * p)
            out += [(a, pid, r, i, -p, -s) for r, (s, i) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mined(df, anchors, **settings):
    got = hard_negatives(df, df.where(F.col("vec_id").isin(list(anchors))), **settings)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force_over_several_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(pivots, "ROWS", 60)
    monkeypatch.setattr(pivots, "ANCHOR_ROWS", 4)
    monkeypatch.setattr(pivots, "SHARD_BLOCKS", 3)
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((6, 12))
    # tight groups, a third of all rows in one label, vectors of another length and repeated ones
    rows = [(i, 0 if i % 3 == 0 else int(draw.integers(1, 5)), (centres[draw.integers(6)] + 0.2 * draw.standard_normal(12)).tolist()) for i in range(300)]
    rows += [(1000 + i, i % 2, draw.standard_normal(5).tolist()) for i in range(20)] + [(2000 + i, i % 3, rows[0][2]) for i in range(8)]
    asked = {0, 7, 14, 150, 1001, 2003}
    want = brute(rows, asked)
    assert want and mined(spark.createDataFrame(rows, SCHEMA), asked) == want
    assert mined(spark.createDataFrame(rows, SCHEMA), asked, positives=2, negatives=3, least=50, most=100) == brute(rows, asked, 2, 3, 50, 100)


def test_query_against_brute_force(spark, sf):
    t = pq.read_table(f"{sf}/embeddings.parquet").to_pylist()
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in t]
    want = brute(rows, {r[0] for r in rows if r[0] % 100 == 0})
    assert sorted(tuple(r) for r in op11_hard_negatives(spark, sf).collect()) == want


def test_odd_rows(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.5, 1.0]), (3, 2, [0.5, -1.0]), (4, None, [0.5, 0.0]), (5, 2, None), (6, 2, []), (7, 2, [None, 1.0]), (8, 2, [float("nan"), 1.0]), (9, 2, [float("inf"), 1.0]), (None, 2, [0.5, 0.0]), (10, 2, [0.5]), (1, 1, [1.0, 0.0]), (11, 3, [0.0, 0.0]), (12, 4, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA + ", rank string, slot int")
    # both rows of id 1 are positives of 0; 3 and 2 tie; anchors alone in their label give nothing
    both = [(0, 1, 1, 2, 65536, 32768), (0, 1, 2, 3, 65536, 32768)]
    assert set(mined(df, {0, 11, 12, 5, 4})) == set(both)
    assert len(mined(df, {0})) == 4  # a repeated positive takes two places, with its own negatives in each
    assert mined(df.limit(0), {0}) == []
    far = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-0.5])], SCHEMA)
    assert mined(far, {0}) == []  # the positive's score is negative


def test_brackets_hold_and_prune(spark):
    draw = np.random.default_rng(2)
    centres = 3 * draw.standard_normal((20, 16))
    X = np.floor(256 * (centres[np.arange(2000) % 20] + 0.05 * draw.standard_normal((2000, 16))))
    Q = X[:40]
    top = float((X * X).sum(axis=1).max())
    lift = np.sqrt(top - (X * X).sum(axis=1))
    P = farthest_first(np.hstack([X, lift[:, None]]), 16)[:, :-1]
    least, most = brackets(distances(Q, np.zeros(40), P, top), distances(X, lift, P, top), Q, top)
    true = Q @ X.T
    assert (least <= true).all() and (true <= most).all()
    tenth = -np.partition(-true, 9, axis=1)[:, 9]
    assert (most >= tenth[:, None]).mean() < 0.5  # where vectors lie in groups, most pairs need no product


def test_shards_hold_all_rows(spark, sf):
    rows = taking_part(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "label", "embedding")
    table = PivotTable(rows)
    assert table.table.agg(F.sum(F.length("ids") / 8)).first()[0] == rows.count() == table.n
    assert len(table.pivots) == pivots.PIVOTS


def test_copies_of_anchors_are_not_broadcast(spark):
    rows = taking_part(spark.createDataFrame([(i, i % 2, [float(i), 1.0]) for i in range(40)], SCHEMA), "vec_id", "label", "embedding")
    ranges = F.array(F.lit(float("-inf")), F.lit(float("inf")))
    found = PivotTable(rows, pivots=2).best(rows.withColumn("ranges", ranges), 1, True, 3)
    assert "strategy=merge" in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 120
