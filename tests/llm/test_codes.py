import hashlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docloom.llm import lloyd
from docloom.llm.q_codes import op13_codes

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Plain rounds with sums made anew each time: {id: (codes, error)}, label errors, entries."""
    rows = sorted(rows, key=lambda r: (r[0], r[2]))
    V = np.array([[int(np.floor(scale * x)) for x in r[2]] for r in rows])
    P = V.reshape(len(V), parts, -1)
    books = [P[:entries, p].copy() for p in range(parts)]
    away = lambda p: ((P[:, p, None, :] - books[p][None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        for p in range(parts):
            near = away(p).argmin(axis=1)
            for e in set(near.tolist()):
                own = P[near == e, p]
                books[p][e] = [int(s) // len(own) for s in own.sum(axis=0)]
    codes = np.stack([away(p).argmin(axis=1) for p in range(parts)], axis=1)
    error = sum(away(p).min(axis=1) for p in range(parts))
    by_label: dict = {}
    for r, e in zip(rows, error.tolist(), strict=True):
        by_label[r[1]] = by_label.get(r[1], 0) + e
    return sorted((r[0], bytes(c), e, by_label[r[1]]) for r, c, e in zip(rows, codes.tolist(), error.tolist(), strict=True)), np.stack(books)


def coded(df, **settings):
    codes, books = lloyd.compressed(df, **settings)
    return sorted((r["id"], bytes(r["code"]), r["error"], r["label_error"]) for r in codes.collect()), books


@pytest.mark.parametrize(("n", "entries", "scale", "spread"), [(300, 16, 1024, 1), (90, 256, 8, 1), (200, 7, 64, 4000), (150, 5, 1 << 13, 2000)])
def test_against_plain_rounds(spark, n, entries, scale, spread):
    draw = np.random.default_rng(n)
    rows = [(i, None if i % 5 == 0 else i % 3, (spread * draw.standard_normal(8)).round(3).tolist()) for i in range(n)]
    rows += [(i, 1, rows[0][2]) for i in range(n, n + 30)]  # ties
    want, books = brute(rows, entries=entries, scale=scale)
    got, found = coded(spark.createDataFrame(rows, SCHEMA).repartition(5), entries=entries, scale=scale)
    assert np.array_equal(books, found)
    assert got == want


def test_labels_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "FEW_LABELS", 2)
    draw = np.random.default_rng(1)
    rows = [(i, None if i % 4 == 0 else i % 7, draw.standard_normal(4).tolist()) for i in range(60)]
    assert coded(spark.createDataFrame(rows, SCHEMA), entries=8)[0] == brute(rows, entries=8)[0]


def test_query_against_plain_rounds(spark, sf):
    t = pq.read_table(f"{sf}/embeddings.parquet").to_pylist()
    want, books = brute([(r["vec_id"], r["label"], r["embedding"]) for r in t])
    text = ",".join(str(x) for part in books for entry in part for x in entry)
    got = op13_codes(spark, sf).collect()
    assert sorted((r["vec_id"], bytes.fromhex(r["code"]), r["error"], r["label_error"]) for r in got) == want
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(text.encode()).hexdigest()}
    assert all(r["code"] == r["code"].lower() and len(r["code"]) == 8 for r in got)


def test_only_moved_parts_contribute(spark):
    draw = np.random.default_rng(4)
    rows = [(i, 0, draw.standard_normal(8).tolist()) for i in range(400)]
    kept = spark.createDataFrame(rows, SCHEMA)
    V = np.floor(1024 * np.array([r[2] for r in rows])).astype("<i2")
    state = kept.select(F.col("vec_id").alias("id"), "label").join(spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(V)], "id long, v binary"), "id")
    books = V[:16].reshape(16, 4, 2).transpose(1, 0, 2).astype(np.int64)
    once = lloyd.assigned(state, books, "<i2").cache()
    again = lloyd.assigned(once, books, "<i2")
    assert lloyd.deltas(once, books, "<i2").where("place = -1").agg(F.sum("n")).first()[0] == 4 * 400
    assert lloyd.deltas(again, books, "<i2").count() == 0
    moved = lloyd.assigned(once, books[:, ::-1], "<i2")  # every entry changes its place
    sums = lloyd.deltas(moved, books, "<i2").where("place = -1").agg(F.sum("n"), F.sum(F.abs("n"))).first()
    assert sums[0] == 0 and sums[1] > 0


def test_odd_rows(spark):
    rows = [(1, 1, [1.0] * 4), (2, None, [0.0] * 4), (3, 1, None), (4, 1, []), (5, 1, [None, 1.0, 1.0, 1.0]), (6, 1, [float("nan")] * 4), (7, 1, [float("-inf")] * 4), (8, 1, [1.0] * 8), (None, 1, [1.0] * 4), (2, None, [0.5] * 4), (9, 2, [-1.0] * 4)]
    df = spark.createDataFrame([(*r, "x", b"y") for r in rows], SCHEMA + ", code string, v binary")
    got, books = coded(df)
    good = [r for r in rows if r[0] in (1, 2, 9) and r[2]]
    assert got == brute(good)[0] and books.shape == (4, 4, 1)
    assert coded(df.limit(0))[0] == []
    assert coded(spark.createDataFrame([(1, 1, [1.0, 2.0, 3.0])], SCHEMA))[0] == []  # can't be cut into four
    huge = coded(spark.createDataFrame([(i, 1, [1e300 * (-1) ** i, -1e30, 1.0, float(i)]) for i in range(40)], SCHEMA), entries=4)[0]
    assert len(huge) == 40 and all(e >= 0 for _, _, e, _ in huge)
