import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import markup, measures


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_sequence_distance(a, b):
    assert measures.sequence_distance(a, b) == plain_distance(a, b)


@settings(max_examples=150, deadline=None)
@given(st.text("ab\U0001f600", max_size=200), st.text("abc\U0001f600", max_size=90))
def test_string_distance(a, b):
    assert measures.string_distance(a, b) == plain_distance(a, b)
    assert measures.string_distance("x" + a + "yy", "x" + b + "yy") == plain_distance(a, b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.tuples(st.lists(st.integers(0, 3), max_size=140), st.lists(st.integers(0, 4), max_size=140))), max_size=12), st.sampled_from([1, 4, 40]))
def test_distances_of_many_pairs_at_once(pairs, wide):
    """Of none, some and several blocks of 64, in groups of any width and one by one."""
    own = [None if p is None else tuple(np.array(x, np.int64) for x in p) for p in pairs]
    want = [None if p is None else plain_distance(*p) for p in pairs]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(measures, "WIDE", wide)
        for least in (1, 1 << 20):
            m.setattr(measures, "LEAST", least)
            assert measures.code_distances(own) == want
        m.setattr(measures, "LEAST", 1)
        m.setattr(measures, "TABLE", 40)
        assert measures.code_distances(own) == want
    spread = [None if p is None else tuple(np.array([x * 70_001 for x in y], np.int64) for y in p) for p in pairs]
    assert measures.code_distances(spread) == want


def test_words_are_split_at_unicode_blanks(spark):
    texts = ["a\x1cb c", "a\u3000b\xa0c", " a  b ", "", "a\u200bb", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(measures.word_distance(F.col("t"), F.lit("")).alias("d"), F.filter(F.split("t", r"(?U)\s+"), lambda w: w != "").alias("w")).collect()
    assert [(r["d"]["distance"], r["d"]["size"]) if r["w"] is not None else None for r in got] == [(len(r["w"]),) * 2 if r["w"] is not None else None for r in got]


def test_pairs_of_texts_are_dealt_to_several_tasks(spark, tmp_path):
    """Not to as many as the ids fill, and shared tokens are counted without a row for each."""
    from docloom.plans import lane_queries

    rows = [(i, None if i == 9 else f"Tok{i % 4} tok1, tok1" if i % 5 else "!", "en", f"s{i % 3}", 0) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert lane_queries._following(spark, str(tmp_path)).rdd.getNumPartitions() == tasks
    overlap = lane_queries.token_multiset_overlap(spark, str(tmp_path))
    assert "Generate" not in overlap._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, t, *_ in rows[:57]:
        if rows[i + 3][1] is not None:
            a, b = (Counter(re.findall("[0-9a-z]+", (x or "").lower())) for x in (t, rows[i + 3][1]))
            if a or b:
                want[i] = ((a & b).total(), a.total(), b.total())
    assert {r[0]: tuple(r[1:]) for r in overlap.collect()} == want


def test_text_distance_of_short_and_long_texts(spark, monkeypatch):
    draw = random.Random(4)
    rows = [("".join(draw.choice("abcé") for _ in range(n)), "".join(draw.choice("abcé") for _ in range(m))) for n, m in ((0, 0), (0, 5), (30, 20), (400, 300), (700, 1), (350, 350))] + [(None, "a"), ("a", None), ("a" * 2000, "a" * 1999 + "b")]
    monkeypatch.setattr(measures, "CELLS", 50_000)
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", measures.text_distance(F.col("a"), F.col("b")).alias("d"), F.levenshtein("a", "b").alias("built_in")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["d"] == r["built_in"] == (None if r["a"] is None or r["b"] is None else plain_distance(r["a"], r["b"]))


def test_wer_query_against_loops(spark, tmp_path):
    """Whole texts of a document and of the next one with its source."""
    from docloom.plans.lane_queries import wer

    draw = random.Random(9)
    words = ["a", "b", "Größe", "c,", "x\ny", "z\t"]
    rows = [(i, None if i == 4 else " ".join(draw.choice(words) for _ in range(draw.choice([0, 1, 7, 300]))), "en", f"s{i % 3}", 0) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    plain = lambda t: "".join(c for c in t if c in "\t\n" or " " <= c <= "~")
    want = {}
    for i, t, _, _, _ in rows:
        other = rows[i + 3][1] if i + 3 < 30 else None
        if t is not None and other is not None:
            a, b = plain(t).split(), plain(other).split()
            want[i] = round(plain_distance(a, b) / len(a), 6) if a else None
    assert {r["doc_id"]: r["wer"] for r in wer(spark, str(tmp_path)).collect()} == want


def forest_distance(f, g, contents):
    """The recursion that defines the distance, on forests of (kind, text, children)."""
    size = lambda t: sum(1 + size(x[2]) for x in t)

    @lru_cache(maxsize=None)
    def d(f, g):
        if not f or not g:
            return float(size(f) + size(g))
        (k, s, c), (m, t, e) = f[-1], g[-1]
        if k != m:
            cost = 1.0
        elif k != "td" or not contents:
            cost = 0.0
        else:
            s, t = "".join(s.split()), "".join(t.split())
            cost = plain_distance(s, t) / max(len(s), len(t), 1)
        return min(d(f[:-1] + c, g) + 1, d(f, g[:-1] + e) + 1, d(f[:-1], g[:-1]) + d(c, e) + cost)

    return d(f, g)


def test_table_trees_against_the_definition():
    draw = random.Random(1)
    table = lambda: [[draw.choice(["a", "ab", "c d", ""]) for _ in range(draw.randrange(0, 4))] for _ in range(draw.randrange(0, 4))]
    tree = lambda rows: (("table", "", tuple(("tr", "", tuple(("td", c, ()) for c in r)) for r in rows)),)
    for _ in range(150):
        a, b = table(), table()
        for contents in (True, False):
            assert abs(measures.table_tree_distance(a, b, contents) - forest_distance(tree(a), tree(b), contents)) < 1e-9


def test_rates(spark):
    df = spark.createDataFrame([("ab cd", "ab cx", [["a", "b"], ["c", "d"]], [["a", "b"], ["c", "x"], ["e", "f"]])], "r string, g string, t array<array<string>>, u array<array<string>>")
    row = df.select(
        measures.character_errors(F.col("r"), F.col("g")).alias("cer"),
        measures.word_errors(F.col("r"), F.col("g")).alias("wer"),
        measures.normalized_distance(F.lit(""), F.lit("")).alias("none"),
        measures.matching_ratio(F.col("r"), F.col("g")).alias("ratio"),
        measures.table_content(F.col("t"), F.col("u")).alias("content"),
        measures.table_structure(F.col("t"), F.col("u")).alias("structure"),
        measures.table_trees(F.col("t"), F.col("u")).alias("trees"),
    ).first()
    assert (row["cer"], row["wer"], row["none"], row["ratio"]) == (0.25, 0.5, None, 0.8)
    assert abs(row["content"] - 0.5) < 1e-9 and abs(row["structure"] - 2 / 3) < 1e-9
    assert abs(row["trees"]["content"] - 0.6) < 1e-9 and abs(row["trees"]["structure"] - 0.7) < 1e-9


def test_markup(spark):
    table = "a | b\n--- | ---\n 1 | 2 "
    marked = "[page 1]\nfirst\n=== page 2 ===\nsecond\n"
    df = spark.createDataFrame([(table, marked, "<table><tr><td>1</td><th>2</th></tr><TR><td>3</td></TR></table>", "no marks")], "t string, p string, h string, n string")
    row = df.select(
        markup.table_rows(F.col("t")).alias("rows"),
        markup.is_table(F.col("t")).alias("is"),
        markup.marked_pages(F.col("p"), "plain").alias("pages"),
        markup.marked_pages(F.col("n"), "comment").alias("none"),
        markup.html_table_shape(F.col("h")).alias("shape"),
        markup.paragraphs(F.lit(" a\n\n \n b\nc ")).alias("paragraphs"),
        markup.occurrences(F.lit("aaaa"), F.lit("aa")).alias("twice"),
    ).first()
    assert row["rows"] == [["a", "b"], ["1", "2"]] and row["is"]
    assert [tuple(x) for x in row["pages"]] == [(1, "first"), (2, "second")]
    assert [tuple(x) for x in row["none"]] == [(1, "no marks")]
    assert tuple(row["shape"]) == (2, 2) and row["paragraphs"] == ["a", "b\nc"] and row["twice"] == 2
