import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import collection, vectors
from docloom.sources import snapshot

SCHEMA = "vec_id long, embedding array<float>"


def grouped(n, dims, groups, spread, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((groups, dims))
    return (centres[draw.integers(groups, size=n)] + spread * draw.standard_normal((n, dims))).astype(np.float32)


@pytest.mark.parametrize(("groups", "spread", "most"), [(30, 0.02, 0.2), (1, 1.0, 1.0)])
def test_exact_and_skipping(spark, tmp_path, groups, spread, most):
    X = grouped(1500, 12, groups, spread)
    X[40:60] = X[7]  # ties
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], SCHEMA)
    odd = spark.createDataFrame([(9000, None), (9001, []), (9002, [float("nan")] * 12), (None, X[0].tolist()), (9003, [1.0])], SCHEMA)
    root = f"file://{tmp_path}/c"
    collection.write_collection(rows.unionByName(odd), root, cells=40)
    asked = rows.where("vec_id % 97 = 0 OR vec_id = 7").unionByName(odd)
    found, share = collection.search_collection(spark, root, asked, 10)
    want = vectors.nearest(asked.where("vec_id < 9000"), rows, 10)
    key = lambda df: sorted((r["query"], r["rank"], r["doc"], r["score"]) for r in df.collect())
    # the blocks' search leaves a query's own row out
    others = vectors.nearest(asked.where("vec_id < 9000").withColumn("vec_id", F.col("vec_id") + 100_000), rows, 10).withColumn("query", F.col("query") - 100_000)
    assert key(found) == key(others) and want.count() == others.count()
    assert 0 < share <= most
    assert {r["query"] for r in found.select("query").distinct().collect()} == {7, *range(0, 1500, 97)}


def test_few_and_no_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], SCHEMA)
    collection.write_collection(rows, f"file://{tmp_path}/a")
    found, _ = collection.search_collection(spark, f"file://{tmp_path}/a", rows, 5)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, 0.0, 1), (1, 2, 2.0, 2), (2, 1, 2.0, 2), (2, 2, 0.0, 1)]
    collection.write_collection(rows.limit(0), f"file://{tmp_path}/b")
    assert collection.search_collection(spark, f"file://{tmp_path}/b", rows, 5)[0].count() == 0


def test_a_matrix_file_is_read_by_ranges(spark, tmp_path):
    X = grouped(1000, 7, 3, 1.0)
    path = f"{tmp_path}/m.npy"
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "row long, vector array<float>")
    assert snapshot.write_matrix(rows.repartition(5), path) == 1000
    assert np.array_equal(np.load(path), X)
    got = snapshot.matrix(spark, path, rows=128)
    assert got.rdd.getNumPartitions() == 8 == snapshot.partitions_of(1000, 128)
    assert np.array_equal(np.array([r["vector"] for r in got.orderBy("row").collect()], np.float32), X)
    assert snapshot.matrix(spark, f"file://{path}").count() == 1000
    for bad in (np.zeros(3), np.asfortranarray(np.zeros((3, 4))), np.array([["a"]])):
        np.save(path, bad)
        with pytest.raises(ValueError):
            snapshot.matrix_shape(path)
    np.save(path, X)
    with open(path, "r+b") as file:
        file.truncate(500)
    with pytest.raises(ValueError):
        snapshot.matrix_shape(path)
    np.save(path, np.zeros((0, 4)))
    assert snapshot.matrix(spark, path).count() == 0


def test_a_local_table_is_read_by_ranges(spark, tmp_path):
    path = f"{tmp_path}/b.sqlite"
    with sqlite3.connect(path) as base:
        base.execute('CREATE TABLE "odd name" (chunk_id TEXT, n INTEGER, x REAL, raw BLOB)')
        base.executemany('INSERT INTO "odd name" VALUES (?, ?, ?, ?)', [(f"c{i}", i, i / 2, bytes([i % 256])) for i in range(300)] + [(None, None, None, None)])
        base.execute('DELETE FROM "odd name" WHERE n % 7 = 3')
        base.execute("CREATE TABLE none (a TEXT)")
    got = snapshot.local_table(spark, path, "odd name", rows=50)
    assert got.dtypes == [("chunk_id", "string"), ("n", "bigint"), ("x", "double"), ("raw", "binary")]
    assert got.rdd.getNumPartitions() == 7
    assert sorted((r["chunk_id"] or "", r["n"] or 0, r["x"] or 0, bytes(r["raw"] or b"")) for r in got.collect()) == sorted([(f"c{i}", i, i / 2, bytes([i % 256])) for i in range(300) if i % 7 != 3] + [("", 0, 0, b"")])
    assert snapshot.local_table(spark, path, "none").count() == 0
    with pytest.raises(Exception, match="no table"):
        snapshot.local_table(spark, path, "other").count()


def test_a_snapshot_is_checked_both_ways(spark, tmp_path):
    X = grouped(20, 3, 2, 1.0)
    path = f"{tmp_path}/e.npy"
    np.save(path, X)
    corpus = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(20)], "chunk_id string, text string")
    numbered = spark.createDataFrame([(i, f"c{i}") for i in range(20)], "row long, chunk_id string")
    stored = spark.createDataFrame([(f"c{i}", x.tolist()) for i, x in enumerate(X)], "chunk_id string, vector array<float>")
    told = {"chunks": 20, "dims": 3, "model": "m", "distance": "squared_l2", "expected": {"model": "m", "distance": "squared_l2"}}
    rows = snapshot.matrix(spark, path, rows=6)
    faults = lambda c=corpus, k=corpus, n=numbered, r=rows, s=stored, t=told: {tuple(x) for x in snapshot.snapshot_faults(c, k, n, r, s, t).collect()}
    assert faults() == set()
    assert faults(k=corpus.where("chunk_id <> 'c3'")) == {("corpus_left", "c3")}
    assert faults(k=corpus.unionByName(corpus.where("chunk_id = 'c3'"))) == {("corpus_right", "c3")}
    other = stored.withColumn("vector", F.when(F.col("chunk_id") == "c5", F.array(*[F.lit(0.0).cast("float")] * 3)).otherwise(F.col("vector")))
    assert faults(s=other) == {("vectors_left", "c5"), ("vectors_right", "c5")}
    assert faults(n=numbered.where("row <> 4")) == {("matrix_rows", "4"), ("without_vector", "c4"), ("vectors_right", "c4")}
    assert faults(t=told | {"chunks": 21, "model": "other"}) == {("count", "20"), ("contract", "model")}
