import os
import tempfile
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from docloom.llm.common import collected, passing, shared_dir, staged
from docloom.llm.line_dedup import dedup_lines
from docloom.llm.ngram_join import bit_set, in_set, one_of_each


def test_shuffle_files_go_with_their_job(spark):
    """What staged() and collected() shuffle doesn't stay on disk until the driver collects its garbage; settings are as before."""
    top = Path(spark.sparkContext.getConf().get("spark.local.dir", os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir())))
    files = lambda: {p for p in top.glob("**/blockmgr-*/*/shuffle_*")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(key), files()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    assert staged(df).count() == 7
    assert sorted(r["n"] for r in collected(df)) == [142, 143, 143, 143, 143, 143, 143]
    kept = {p.name.split("_")[1] for p in files() - before}
    assert len(kept) <= 1  # that of count()
    assert spark.conf.get(key) == setting


def tables(spark) -> set[Path]:
    return set(Path(shared_dir(spark).removeprefix("file://")).glob("docloom-*"))


def test_passing_tables_go(spark):
    """What stays is left to the block around; the rest goes, also when a block fails."""
    before = tables(spark)
    with passing(spark) as outer:
        with passing(spark) as inner:
            staged(spark.range(3), "gone")
            two = inner(staged(spark.range(4), "two").where("id > 1"))
            three = inner(staged(spark.range(5), "three"))
        assert {p.name.split("-")[1] for p in tables(spark) - before} == {"two", "three"}
        outer(three)
        assert two.count() == 2
    assert {p.name.split("-")[1] for p in tables(spark) - before} == {"three"}
    assert three.count() == 5
    try:
        with passing(spark):
            staged(spark.range(3), "failed")
            raise KeyError
    except KeyError:
        pass
    assert {p.name.split("-")[1] for p in tables(spark) - before} == {"three"}


def test_operators_leave_only_what_their_result_reads(spark):
    """Tables written on the way don't stay beside the result: near copies and repeated runs of lines, over several rounds."""
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words[: i % 50], f"x{i}", *words[i % 50 : 100]]) + "\n" + "\n".join(words[100:])) for i in range(40)] + [(100, "one\ntwo\nthree\nfour"), (101, "one\ntwo\nthree\nfive")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for run, n, most in ((one_of_each, 3, 2), (dedup_lines, 42, 1)):
        before = tables(spark)
        out = run(docs)
        left = tables(spark) - before
        assert out.count() == n
        assert len(left) <= most, left


def test_few_keys_make_a_small_bit_set(spark):
    few = spark.range(1000).select(F.xxhash64("id"))
    keys = np.array([r[0] for r in few.collect()])
    bits = bit_set(few)
    assert len(bits) < 1 << 16
    assert in_set(bits, keys).all()
    assert in_set(bits, np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 100_000)).mean() < 0.02
    assert not in_set(bit_set(few.where("false")), keys).any()
