"""Operators of a few lines each, on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import chunks, lineage, lines, metrics, search, state, validation
from docloom.sources import writers


def told(spark, column, rows, schema):
    return [r["x"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").select("i", column.alias("x")).orderBy("i").collect()]


def test_texts(spark):
    assert told(spark, text.scalar_terms(F.col("t")), [('{"a": [1, {"b": " x "}], "c": null, "d": "", "e": 2.5}',), ("no json",), (None,), ('"one"',)], "t string") == [["1", "x", "2.5"], [], [], ["one"]]
    assert told(spark, text.in_fixed_order(F.col("v"), ["a", "b", "c"]), [(["c", "a", "c", "z"],)], "v array<string>") == [["a", "c"]]
    hints = {"소비 영역": F.col("s"), "선호 혜택": F.col("b")}
    assert told(spark, text.with_hints(F.col("q"), hints), [("카드", ["여행", "커피"], []), ("카드", [], []), ("카" * 1025, [], [])], "q string, s array<string>, b array<string>") == ["카드\n검색 힌트: 소비 영역=여행,커피", "카드", None]
    assert told(spark, text.with_tables(F.col("m"), F.col("t")), [("a [t1](t1) [t2](t2) ", {"t1": "|x|"})], "m string, t map<string,string>") == ["a |x| [t2](t2)"]
    paths = ["data/raw/BC/card.pdf", "data/raw/card.pdf", "data/raw/a/../b.pdf", "raw/a/b.pdf", "data/raw/a//b.pdf", "data/raw/a/b.txt", "data/raw/a/" + "x" * 70 + ".pdf", "data/raw/a/b .pdf", "data/raw/a\\\\c/b.pdf"]
    assert told(spark, text.card_key(F.col("p")), [(p,) for p in paths], "p string") == ["BC/card"] + [None] * 8
    assert told(spark, text.short_title(F.col("q")), [("가" * 40,), ("a",)], "q string") == ["가" * 32, "a"]
    at = spark.createDataFrame([(1,)], "i int").select(text.utc_stamp(F.timestamp_micros(F.lit(1_700_000_000_000_001))).alias("x")).first()["x"]
    assert at == "2023-11-14T22:13:20.000001+00:00"


def test_numeric_labels(spark):
    pages = spark.createDataFrame([("d", 1, "연회비 1만 원, 전월 실적 30만원" + " ." * 200 + " 30만원 aa aaa"), ("d", 2, None)], "doc string, page int, text string")
    rows = [("d", 1, "a", "30만원", ["실적"], 1, True), ("d", 1, "b", "30만 원", [], 2, False), ("d", 1, "c", "1만원", ["연회비"], None, True), ("d", 1, "e", "aa", [], 4, False), ("d", 1, "f", "(5)", [], 1, True), ("d", 2, "g", "1", [], 0, False), ("d", 3, "h", "1", None, 1, False)]
    labels = spark.createDataFrame(rows, "doc string, page int, label string, surface string, context array<string>, expected int, critical boolean")
    scored = metrics.numeric_labels(pages, labels, ["doc", "page"], "label")
    got = {r["label"]: (r["found"], r["in_context"], r["exact"], r["related"]) for r in scored.collect()}
    assert got == {"a": (2, 1, True, True), "b": (2, 2, True, True), "c": (1, 1, True, True), "e": (4, 4, True, True), "f": (0, 0, False, False), "g": (0, 0, False, True), "h": (0, 0, False, False)}
    rates = metrics.numeric_label_rates(scored).first()
    assert (rates["labels"], round(rates["exact_rate"], 4), round(rates["related_rate"], 4), round(rates["critical_rate"], 4)) == (7, 0.5714, 0.7143, 0.6667)


def test_states(spark):
    rows = spark.createDataFrame([(1, [0.5, 1.0], "m"), (2, None, "m"), (3, [0.5], "n"), (4, [1.0], "m")], "i int, embedding array<float>, embedding_model string")
    assert tuple(state.embedding_status(rows, "m").first()) == (4, 2, [1, 2])
    cases = spark.createDataFrame([("e", i) for i in range(9)] + [("f", 1)], "experiment string, case int")
    done = spark.createDataFrame([("e", 0), ("e", 3)], "experiment string, case int")
    assert sorted((r["experiment"], r["case"]) for r in state.next_cases(cases, done, ["experiment"], "case", "case", 3).collect()) == [("e", 1), ("e", 2), ("e", 4), ("f", 1)]
    stages = ["extract", "structure", "validate"]
    told = [("r", "a", "extract", "done"), ("r", "b", "extract", "done"), ("r", "a", "structure", "done"), ("r", "b", "structure", "failed"), ("s", "a", "extract", "done"), ("s", "a", "structure", "done"), ("s", "a", "validate", "done"), ("t", "a", "extract", "failed"), ("t", "a", "structure", "done")]
    got = {r["run"]: (r["completed"], r["stopped_before"]) for r in state.stage_barrier(spark.createDataFrame(told, "run string, item string, stage string, status string"), ["run"], stages).collect()}
    assert got == {"r": (["extract"], "validate"), "s": (stages, None), "t": ([], "structure")}
    asked = spark.createDataFrame([("q", "a"), ("q", "b")], "query string, card string")
    assert [tuple(r) for r in search.unserved(asked, asked.where("card = 'a'"), ["query", "card"]).collect()] == [("q", "b")]


def test_lineage_of_chunks(spark):
    schema = "document string, sha string, version string"
    sources = spark.createDataFrame([("a", "1", "v"), ("b", "2", "v")], schema)
    both = spark.createDataFrame([("a", "1", "v"), ("b", "2", "v"), ("b", "2", "v")], schema)
    fresh = lambda p, c: tuple(lineage.chunk_freshness(p, c, sources, ["sha", "version"]).first())
    assert fresh(both, both) == (3, 3, False, 3, 3)
    assert fresh(both, both.where("document = 'a'")) == (0, 0, True, 3, 1)
    assert fresh(both, both.withColumn("sha", F.lit("1"))) == (0, 0, True, 3, 3)
    assert fresh(both.limit(0), both.limit(0)) == (0, 0, False, 0, 0)
    levels = spark.createDataFrame([("page", None), ("page", "x"), ("card", None)], "level string, problem string")
    assert sorted(map(tuple, lineage.level_counts(levels, "level", "problem").collect())) == [("card", 1, 0), ("page", 2, 1)]
    vectors = spark.createDataFrame([("a", [0.1, 0.2]), ("b", [0.3, 0.4])], "k string, v array<float>")
    one = lambda df: lineage.matrix_fingerprint(df, "k", "v").first()[0]
    assert one(vectors) == one(vectors.orderBy(F.desc("k"))) != one(vectors.withColumn("v", F.reverse("v")))


def test_table_hints(spark):
    units = spark.createDataFrame([("d", 0, "월간할인한도표"), ("d", 1, "전혀다른글이다"), ("d", 2, "표"), ("e", 3, "월간할인한도표")], "doc string, unit int, text string")
    hints = spark.createDataFrame([("d", "할인한도"), ("d", ""), ("d", "표")], "doc string, hint string")
    assert sorted(r["unit"] for r in chunks.hinted(units, hints, ["doc"], "unit").collect()) == [0, 2]


def test_the_active_release_follows_its_pointer(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    vectors = spark.createDataFrame([("c", [0.5])], "chunk_id string, embedding array<float>")
    releases = [writers.publish(spark.createDataFrame([("c", t)], "chunk_id string, text string"), vectors, root) for t in ("one", "two")]
    writers.activate(spark, root, releases[0])
    handle = writers.ActiveRelease(spark, root)
    assert handle.table("chunks").first()["text"] == "one" and handle.table("chunks") is handle.table("chunks")
    writers.activate(spark, root, releases[1])
    assert handle.table("chunks").first()["text"] == "two"


def test_fragments_are_put_right(spark):
    cases = [
        ("abc abc", "abc", 4, 7, (4, 7)),  # as given
        ("abc abd", "abd", 0, 3, (4, 7)),  # shifted
        ("abc abc", "abc", 1, 4, "ambiguous"),
        ("abc", "x", 0, 1, "unresolved"),
        ("aaa", "aa", 5, 7, (0, 2)),
        ("abc", "", 0, 0, "unresolved"),
        ("할인 10 %", "할인10%", 9, 9, (0, 7)),  # other blanks
        ("ＡＢＣ １０％ 할인", "10%할인", -1, 3, (4, 10)),  # wide letters
        ("①번 ‘혜택’", "1번 '혜택'", 0, 0, (0, 7)),
        ("10 20 10 20", "10 20", 0, 0, "ambiguous"),
        ("10  20", "10 20", 0, 0, (0, 6)),
        ("10 20", "1020", 0, 0, "unresolved"),  # blanks part numbers
        ("## 제목 글", "• 제목글", 0, 0, (3, 7)),
        ("가 나 가나", "가  나", 0, 0, "unresolved"),  # twice in the presentation form
        ("x할인y", "할인", 1, 3, (1, 3)),
        (None, "x", 0, 1, "unresolved"),
    ]
    rows = [c[:4] for c in cases]
    got = told(spark, lines.fragment_range(F.col("l"), F.col("f"), F.col("s"), F.col("e")), rows, "l string, f string, s int, e int")
    assert [(x["start"], x["end"]) if x["error"] is None else x["error"] for x in got] == [c[4] for c in cases]
    allowed = F.array(F.struct(F.lit(4).alias("start"), F.lit(7).alias("end")))
    got = told(spark, lines.fragment_range(F.col("l"), F.col("f"), F.col("s"), F.col("e"), allowed), [("abc abc", "abc", 0, 3), ("abc abd", "abc", 0, 3), ("a b a b", "ab", 0, 3)], "l string, f string, s int, e int")
    assert [(x["start"], x["end"]) if x["error"] is None else x["error"] for x in got] == [(4, 7), "unresolved", (4, 7)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_nearest_siblings_in_one_group_of_ties(spark, partitions):
    draw = random.Random(partitions)
    rows = [("hot", i, draw.choice([1, 5, 5, 5, 9, 30])) for i in range(80)] + [(None, 200 + i, i % 3) for i in range(9)] + [(f"s{i % 4}", 100 + i, draw.randrange(6)) for i in range(40)] + [("alone", 999, 1)]
    got = {}
    for r in lines.nearest(spark.createDataFrame(rows, "p string, own int, at int").repartition(partitions), "p", "own", "at", 3).collect():
        got.setdefault(r["own"], []).append((r["n"], r["neighbour"]))
    want = {}
    for p, n, at in rows:
        near = sorted((abs(a - at), a, m) for q, m, a in rows if q == p and m != n)[:3]
        if near:
            want[n] = [(i, m) for i, (_, _, m) in enumerate(near, 1)]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_children_of_many_paragraphs(spark):
    """One row of 10,000 paragraphs: every one is in a child, in order, and none is too long."""
    words = [f"p{i} " + "x" * (i % 90) for i in range(10_000)]
    got = chunks.children(spark.createDataFrame([(1, "\n\n".join(words))], "id int, text string"), "id").orderBy("part").collect()
    assert [r["part"] for r in got] == list(range(len(got))) and all(len(r["text"]) <= 1600 for r in got)
    seen = [p for r in got for p in r["text"].split("\n\n")]
    at = 0
    for w in words:
        at = seen.index(w.strip(), at) + 1


def test_alignment_by_pairs(spark):
    pages = [(1, ["a b c", "heading one", "x", "heading two", "heading one"], ["heading one", "heading two", "heading one", "", "none of it"]), (2, [], ["x"]), (3, ["x"], []), (4, ["alpha beta", "alpha betb"], ["alpha betz", "alpha betz"])]
    got = sorted((r["page"], r["heading"], r["paragraph"]) for r in chunks.aligned_headings(spark.createDataFrame(pages, "page int, paragraphs array<string>, headings array<string>"), ["page"]).collect())
    assert got == [(1, 0, 1), (1, 1, 3), (1, 2, 4), (4, 0, 0), (4, 1, 1)]


def test_bindings(spark):
    schema = "id string, sha string, n int"
    a = spark.createDataFrame([("x", "1", 1), ("y", "2", None), ("z", "3", 3)], schema)
    b = spark.createDataFrame([("x", "1", 1), ("y", "9", 2), ("w", "4", 4)], schema)
    got = sorted((r["id"], r["problem"]) for r in lineage.binding_violations(a, b, ["id"], ["sha", "n"]).collect())
    assert got == [("w", "not told"), ("y", "n"), ("y", "sha"), ("z", "missing")]


def test_builds_agree_with_their_summary(spark):
    build = {"source_sha256": "s", "primary_config_sha256": "p", "layout_config_sha256": "l", "chunker_version": "v1", "child_max_chars": 10, "child_overlap_chars": 2}
    types = "chunk_id string, parent_id string, document_id string, kind string, text string, table_atomic boolean, source_sha256 string, primary_config_sha256 string, layout_config_sha256 string, chunker_version string, child_max_chars int, child_overlap_chars int"
    frame = lambda rows: spark.createDataFrame([tuple((build | {"table_atomic": False} | r).get(c.split()[0]) for c in types.split(", ")) for r in rows], types)
    parents = [{"chunk_id": f"p{d}", "document_id": d, "kind": "parent", "text": "whole"} for d in "ab"]
    children = [{"chunk_id": f"c{d}", "parent_id": f"p{d}", "document_id": d, "kind": "child", "text": "part"} for d in "ab"]
    documents = spark.createDataFrame([(d, "s", "p", "l") for d in "ab"], "document_id string, source_sha256 string, primary_config_sha256 string, layout_config_sha256 string")
    print_ = lambda df: lineage.fingerprint(df, "chunk_id", validation.corpus_content()).first()[0]

    def summary(p, c, **change):
        row = {"document_ids": ["a", "b"], "document_count": 2, "expected_document_count": 2, "parent_count": 2, "child_count": 2, "parent_corpus": print_(p), "child_corpus": print_(c), "chunker_version": "v1", "child_max_chars": 10, "child_overlap_chars": 2} | change
        return spark.createDataFrame([tuple(row.values())], "document_ids array<string>, document_count int, expected_document_count int, parent_count int, child_count int, parent_corpus string, child_corpus string, chunker_version string, child_max_chars int, child_overlap_chars int")

    p, c = frame(parents), frame(children)
    found = lambda p, c, s: {(r["id"], r["rule"]) for r in validation.build_violations(p, c, documents, s).collect()}
    assert found(p, c, summary(p, c)) == set()
    worse = frame([children[0] | {"text": "x" * 11, "kind": "parent"}, children[1] | {"parent_id": "none", "source_sha256": "old"}])
    assert found(p, worse, summary(p, c)) == {("ca", "child_kind"), ("ca", "child_too_long"), ("cb", "orphan"), ("cb", "stale_chunk"), ("summary", "child_corpus")}
    fewer = frame([parents[0], parents[0] | {"parent_id": "pa"}])
    got = found(fewer, c, summary(fewer, c, document_ids=["b", "a", "z"], child_overlap_chars=10, child_count=3))
    assert {("pa", "chunk_id_twice"), ("pa", "parent_kind"), ("b", "document_without_parents"), ("z", "document_unknown"), ("cb", "orphan"), ("summary", "document_ids_order"), ("summary", "chunk_sizes"), ("summary", "child_count"), ("summary", "document_count"), ("pa", "stale_chunk")} <= got
