import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.llm import line_dedup
from docloom.llm.line_dedup import copied_lines, dedup_lines, suffix_intervals

SCHEMA = "doc_id long, text string"


def brute(rows, least, words=50):
    """What each place shares with any earlier place, from all pairs of places; runs are those that are no tails."""
    lines = {d: [(i, x) for i, x in enumerate(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)] for d, t in rows if t}
    every = [(d, p) for d in sorted(lines) for p in range(len(lines[d]))]
    shared = dict.fromkeys(every, 0)
    for n, (d, p) in enumerate(every):
        for e, q in every[:n]:
            k = 0
            while p + k < len(lines[d]) and q + k < len(lines[e]) and lines[d][p + k][1] == lines[e][q + k][1]:
                k += 1
            shared[d, p] = max(shared[d, p], k)
    out = []
    for d, text in rows:
        if not text:
            out.append((d, 0, 0, 0, text))
            continue
        gone = {p + k for p in range(len(lines[d])) if shared[d, p] >= least for k in range(shared[d, p])}
        alone = {p for p in range(len(lines[d])) if p not in gone and shared[d, p] and len(lines[d][p][1].encode().split()) >= words}
        runs = sum(shared[d, p] >= least and shared[d, p] > max(0, shared.get((d, p - 1), 0) - 1) for p in range(len(lines[d])))
        dead = {lines[d][p][0] for p in gone | alone}
        whole = text.split("\n")
        out.append((d, len(whole), len(dead), runs + len(alone), "\n".join(x for i, x in enumerate(whole) if i not in dead)))
    return sorted(out, key=str)


def varied(seed):
    draw = random.Random(seed)
    pool = [f"line {i}" for i in range(12)] + ["", "  ", "été \U0001f600", "x"]
    rows = []
    for i in range(60):
        lines = [draw.choice(pool) if draw.random() < 0.6 else f"own {draw.randrange(10**9)}" for _ in range(draw.randrange(0, 15))]
        rows.append((i, "\n".join(lines)))
    runs = ["\n".join(f"run {k} {i}" for i in range(draw.randrange(2, 9))) for k in range(4)]
    for i in range(80, 100):
        rows.append((i, "\n".join(draw.choice([*runs, f"own {draw.randrange(10**9)}", " ".join(["wide"] * draw.choice([49, 50]))]) for _ in range(draw.randrange(1, 6)))))
    return [*rows, (70, None), (71, ""), (72, "\n".join(["same"] * 37)), (73, "\n".join(["same"] * 41)), rows[0], (200, rows[5][1])]


@pytest.mark.parametrize(("seed", "least"), [(1, 2), (2, 1), (3, 3), (4, 5)])
def test_brute_force(spark, seed, least):
    rows = [r for i, r in enumerate(varied(seed)) if r[0] != 0 or i == 0]
    got = dedup_lines(spark.createDataFrame(rows, SCHEMA), least).select("doc_id", "n_lines", "n_deleted", "n_runs", "text").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, least)


def test_suffix_ranks_by_doubling(spark):
    """Depth by depth, suffixes of one rank share so many lines, ranks keep one order, and all shared suffixes are there."""
    rows = [(i, t) for i, t in dict(varied(6)).items() if t]
    docs = spark.createDataFrame(rows, "row_key long, text string")
    lines = {d: [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)] for d, t in rows}
    for depth, table in suffix_intervals(docs):
        by_rank: dict = {}
        for r in table.collect():
            by_rank.setdefault(r["rank"], []).append((tuple(lines[r["row_key"]][r["place"] : r["place"] + depth]), (r["row_key"], r["place"]), tuple(r["first"]), r["n"]))
        every = Counter(tuple(x[p : p + depth]) for x in lines.values() for p in range(len(x) - depth + 1))
        assert {k: v for k, v in every.items() if v > 1} == {x[0][0]: len(x) for x in by_rank.values()}
        for x in by_rank.values():
            assert len({y[0] for y in x}) == 1 and {y[2] for y in x} == {min(y[1] for y in x)} and {y[3] for y in x} == {len(x)}


def test_runs_from_several_places_overlap(spark):
    rows = [(1, "a\nb\nq"), (2, "b\nc\nr"), (3, "a\nb\nc"), (4, "q\nx\na\nb\nc\ny"), (5, "a\nb\nq")]
    got = {r["doc_id"]: (r["text"], r["n_runs"]) for r in dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    # 3 holds a b of 1 and b c of 2; 4 holds a b c of 3, one run; 5 is 1
    assert got == {1: ("a\nb\nq", 0), 2: ("b\nc\nr", 0), 3: ("", 2), 4: ("q\nx\ny", 1), 5: ("", 1)}
    runs = copied_lines(spark.createDataFrame(rows, "row_key long, text string")).where("opens").collect()
    assert sorted((r["row_key"], r["place"], r["len"], tuple(r["source"])) for r in runs) == [(3, 0, 2, (1, 0)), (3, 1, 2, (2, 0)), (4, 2, 3, (3, 0)), (5, 0, 3, (1, 0))]


def test_many_copies_of_one_interval_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SALT_ROWS", 3)
    rows = [(i, f"top {i % 2}\nx\ny\nz\nend {i % 3}") for i in range(40)]
    got = dedup_lines(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_lines", "n_deleted", "n_runs", "text").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 2)


def test_long_text_of_many_copies(spark):
    text = "\n".join(f"line {i}" for i in range(20_000))
    out = dedup_lines(spark.createDataFrame([(1, text), (2, text + "\nlast")], SCHEMA)).orderBy("doc_id").collect()
    assert [(r["n_deleted"], r["n_runs"], len(r["text"])) for r in out] == [(0, 0, len(text)), (20_000, 1, 4)]


def test_no_lines_repeat(spark):
    rows = [(1, "a\nb"), (2, "c")]
    assert [tuple(r) for r in dedup_lines(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()] == [(1, "a\nb", 2, 0, 0), (2, "c", 1, 0, 0)]


def test_odd_rows(spark, odd, odd_rows, empty):
    named = odd.withColumnRenamed("lang", "n_lines")
    out = dedup_lines(named)
    assert out.columns == ["doc_id", "text", "source", "n_chars", "n_lines", "n_deleted", "n_runs"]
    assert out.count() == len(odd_rows)
    assert out.where(F.col("text").isNull()).count() == 1
    assert out.agg(F.sum("n_deleted")).first()[0] == 2  # two later copies of one line of 80 words; the long text has no repeated run
    assert dedup_lines(empty).count() == 0
