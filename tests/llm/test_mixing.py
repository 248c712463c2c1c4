import math
import random
import re

from pyspark.sql import functions as F

from docloom.llm import mixing
from docloom.llm.q_mixing import SQL, WEIGHTS, op5_mixing


def shared_targets(sizes: dict, weights=WEIGHTS, most: float = 3) -> dict:
    """Reshare the excess by weight until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = float(sum(sizes.values())), list(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > most * sizes[s]]
        if not full:
            return target | {s: level * weight[s] for s in free}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def test_targets_by_resharing(spark):
    draw = random.Random(5)
    for _ in range(6):
        sizes = {f"s{i}": draw.choice([0, 3, 50, 1000, 20_000]) for i in range(draw.randrange(1, 9))} | ({None: 40} if draw.random() < 0.5 else {})
        rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_docs long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(rows, WEIGHTS).collect()}
        want = shared_targets(sizes)
        for s in sizes:
            assert math.isclose(got[s], want.get(s, 0.0), rel_tol=1e-9, abs_tol=1e-9), (sizes, s)


def test_odd_rows(spark, odd, odd_rows, empty):
    rows = mixing.mix(odd, WEIGHTS).collect()
    assert len(rows) == len(odd_rows)
    sizes: dict = {}
    for _, text, _, source, _ in odd_rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    target, biggest = shared_targets(sizes), {}
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        biggest[r["source"]] = max(biggest.get(r["source"], 0), r["size"])
    for s in sizes:
        taken = sum(r["taken"] for r in rows if r["source"] == s)
        assert abs(taken - target[s]) <= biggest[s]
    assert mixing.mix(empty, WEIGHTS).count() == 0
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(odd.repartition(3), WEIGHTS).collect()), key=str)


def test_bins_don_t_change_the_draw(spark, sf, monkeypatch):
    whole = sorted(op5_mixing(spark, sf).collect())
    monkeypatch.setattr(mixing, "BIN_ROWS", 2)
    assert sorted(op5_mixing(spark, sf).collect()) == whole


def test_bins_are_even_for_any_weights(spark, monkeypatch):
    """A clean source, one of markup alone, and a mixture: no bin holds many times the mean."""
    monkeypatch.setattr(mixing, "BIN_ROWS", 200)
    rows = spark.range(60_000).select(F.col("id"), F.array(F.lit("clean"), F.lit("noise"), F.lit("both")).getItem((F.col("id") % 3).cast("int")).alias("source"), F.lit(1).cast("long").alias("size"))
    weight = F.when(F.col("source") == "clean", 1.0).when(F.col("source") == "noise", 1 / 21).otherwise(F.when(F.rand(3) < 0.5, 1.0).otherwise(0.05 + F.rand(4) / 5))
    rows = rows.withColumn("weight", weight).withColumn("key", -F.log(1 - F.rand(5)) / F.col("weight")).cache()
    binned = rows.join(mixing.rates(rows).withColumn("bins", F.ceil(F.col("n_docs") / mixing.BIN_ROWS)), "source").withColumn("bin", mixing.key_bin())
    for r in binned.groupBy("source", "bin").count().groupBy("source").agg(F.count(F.lit(1)).alias("bins"), F.max("count").alias("most")).collect():
        assert r["bins"] == 100 and r["most"] < 400, r
    for r in binned.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("key", "bin"))).alias("x")).collect():
        assert all(a["bin"] <= b["bin"] for a, b in zip(r["x"], r["x"][1:], strict=False))


def test_mixed_repeats_rows(spark, odd):
    out = mixing.mixed(odd, WEIGHTS)
    assert out.columns == odd.columns
    words = lambda df: df.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert abs(words(out) - words(odd)) <= 40_000


def test_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({SQL})").fetchall())
    got = sorted(map(tuple, op5_mixing(spark, sf).collect()))
    assert [(*r[:3], round(r[3], 6), r[4]) for r in got] == [(*r[:3], round(r[3], 6), r[4]) for r in want]
