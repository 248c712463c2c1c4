import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import blocks, chunks, fusion, lanes, lexical, lines, lineage, metrics, ranking, search, state, validation, vectors
from docloom.operators.search import SearchConfig


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_fusion(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query int, doc string, rank int")
    b = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query int, doc string, rank int")
    got = {r["doc"]: r["score"] for r in fusion.rrf([a, b]).collect()}
    assert got["b"] == round(1 / 62 + 1 / 61, 12)
    both = fusion.weighted_rrf({"bm25": a, "vector": b}, {"bm25": 0.6, "vector": 0.4})
    assert [r["doc"] for r in both.orderBy("rank").collect()] == ["b", "a", "c"]
    only = fusion.weighted_rrf({"bm25": a, "vector": b}, {"bm25": 1.0, "vector": 0.0})
    assert rows(only, "doc", "rank_vector") == [("a", None), ("b", None)]
    # equal scores: the better component rank, then the document
    first = fusion.weighted_rrf({"l": a.where("doc = 'a'"), "r": b.where("doc = 'b'")}, {"l": 0.5, "r": 0.5})
    assert [r["doc"] for r in first.orderBy("rank").collect()] == ["a", "b"]


CHUNKS = [("c1", "k1", "benefit", "one two"), ("c2", "k1", "page", "one"), ("c3", "k2", "benefit", "one three"), ("c4", "k2", "section", "two"), ("c5", "k3", "benefit", "one two three")]


@pytest.fixture
def corpus(spark):
    chunks_ = spark.createDataFrame([(d, c, c.upper(), "bank", level, t) for d, c, level, t in CHUNKS], "doc string, card string, card_name string, issuer string, level string, text string")
    keyword = spark.createDataFrame([(1, d, float(s)) for d, s in (("c2", 9), ("c5", 8), ("c1", 5), ("c3", 4), ("c4", 1))], "query int, doc string, score double")
    vector = spark.createDataFrame([(1, d, float(s)) for d, s in (("c2", 0), ("c1", 1), ("c5", 2), ("c4", 3), ("c3", 4))], "query int, doc string, score double")
    return chunks_, keyword, vector, spark.createDataFrame([(1, "what?")], "query int, question string")


def kept(out):
    return [r["doc"] for r in out.where("status = 'kept'").orderBy("evidence_rank").collect()]


def test_search(corpus):
    chunks_, keyword, vector, queries = corpus
    assert kept(search.search(chunks_, keyword, vector, queries)) == ["c5", "c1", "c3", "c4"]
    # the worklist is cut before the level filter without a scope, after it with one
    assert kept(search.search(chunks_, keyword, vector, queries, SearchConfig(targets=("k2", "k1")))) == ["c3", "c1", "c4"]
    assert kept(search.search(chunks_, keyword, vector, queries, SearchConfig(owned=("k1",), fresh=("k3", "k2")))) == ["c1", "c5", "c3", "c4"]
    assert kept(search.search(chunks_, keyword, None, queries, SearchConfig(vector_weight=0.0, allowed=("k2",)))) == ["c3", "c4"]
    worst_first = search.search(chunks_, keyword, vector, queries, rerank=lambda q, t: [float(-len(x)) for x in t])
    assert kept(worst_first)[0] == "c4"
    tiny = search.search(chunks_, keyword, vector, queries, SearchConfig(payload_bytes=60))
    assert rows(tiny, "status")[0] == ("error",)
    with pytest.raises(ValueError, match="disjoint"):
        SearchConfig(owned=("a",), fresh=("a",))
    with pytest.raises(ValueError, match="targets"):
        SearchConfig(targets=("a", "a"))


def test_hybrid_modes(corpus):
    _, keyword, vector, _ = corpus
    near = vector.withColumn("score", -F.col("score"))
    top = lambda mode: search.hybrid(keyword, near, mode).where("rank = 1").first()["doc"]
    assert [top(m) for m in ("keyword", "vector", "hybrid", "weighted")] == ["c2"] * 4
    with pytest.raises(ValueError, match="unknown"):
        search.hybrid(keyword, near, "other")


def test_collapse_limits_count_kept_rows(spark):
    ranked = spark.createDataFrame([(1, "q", f"d{i}", f"k{i % 4}", "n", "i", "x" * 10, i) for i in range(1, 13)], "query int, question string, doc string, card string, card_name string, issuer string, text string, rank int")
    out = ranking.collapse_in_budget(ranked, top_groups=2, per_group=2)
    assert [r["doc"] for r in out.where("status = 'kept'").orderBy("evidence_rank").collect()] == ["d1", "d2", "d5", "d6"]
    assert ranking.collapse_in_budget(ranked, budget=150).where("status = 'unread'").count() > 0


def test_bm25_statistics_are_global(spark):
    docs = spark.createDataFrame([(1, "coffee shop"), (2, "coffee"), (3, "tea")], "id int, text string")
    index = lexical.build_index(docs, "id", lexical.ascii_tokens(F.col("text")))
    scored = lexical.bm25(index, lexical.query_terms(docs.where("id = 2").withColumnRenamed("id", "q"), "q", lexical.ascii_tokens(F.col("text"))))
    assert [r["doc"] for r in lexical.top_k(scored, 5).orderBy("rank").collect()] == [2, 1]


def test_pairing(spark):
    left = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "a", "x"), (1, 3, "b", "y"), (1, 4, "c", "z"), (1, 5, "d", "z")], "doc int, i int, key string, anchor string")
    right = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "B", "y"), (1, 3, "C", "z"), (1, 4, "Q", "w")], "doc int, i int, key string, anchor string")
    got = rows(lanes.unique_pairs(left, right, ["doc"], "key", "anchor", "i"), "left_i", "right_i", "match")
    assert set(got) == {(1, 1, "equal"), (3, 2, "paired"), (2, None, "unmatched"), (4, None, "ambiguous"), (5, None, "ambiguous"), (None, 3, "ambiguous"), (None, 4, "unmatched")}


def test_chunks_cover_their_text(spark):
    text = "\n\n".join("w" * n for n in (10, 900, 700, 2000, 5))
    table = "a | b\n--- | ---\n1 | 2"
    got = chunks.children(spark.createDataFrame([(1, text + "\n\n" + table)], "id int, text string"), "id").collect()
    assert all(len(r["text"]) <= 1600 or r["atomic"] for r in got)
    assert [r["text"] for r in got if r["atomic"]] == [table]
    assert max(len(r["text"]) for r in got) == 1600
    packs = chunks.packs(spark.createDataFrame([(1, ["aaa", "bb", "c" * 12, "d"])], "id int, u array<string>"), "id", F.col("u"), 5, "\n").collect()
    assert [r["text"] for r in packs] == ["aaa", "bb", "ccccc", "ccccc", "cc\nd"] and [(r["first"], r["last"]) for r in packs] == [(0, 0), (1, 1), (2, 2), (2, 2), (2, 3)]
    w = chunks.windows(spark.createDataFrame([("x" * 3500,), ("",), (None,), ("y" * 1600,)], "text string")).collect()
    assert [(r["start"], len(r["window"])) for r in w] == [(0, 1600), (1440, 1600), (2880, 620), (0, 1600)]


def test_heading_paths(spark):
    text = "intro\n# A\nx\n## B\ny\n### C\n## D\nz\n# E\nend"
    table = lines.registry(spark.createDataFrame([(1, 1, text)], "doc int, page int, text string"), "doc")
    got = {r["line_no"]: (r["level"], r["node"], r["parent"], r["path"]) for r in lines.heading_paths(table, ["doc"]).collect()}
    assert got[1] == (None, 0, 0, []) and got[3] == (None, 1, 1, ["A"])
    assert got[4] == (2, 2, 1, ["A", "B"]) and got[6] == (3, 3, 2, ["A", "B", "C"]) and got[8] == (None, 4, 4, ["A", "D"]) and got[10] == (None, 5, 5, ["E"])


def test_alignment_keeps_order(spark):
    pages = spark.createDataFrame([(1, ["first things", "body", "second part", "tail"], ["second part", "first things", "tai"])], "page int, paragraphs array<string>, headings array<string>")
    assert rows(chunks.aligned_headings(pages, ["page"]), "paragraph", "heading", "score") == [(2, 0, 1.0), (3, 2, 1.0)]


def test_metrics(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 4), (3, None), (4, 11)], "query int, rank int")
    row = metrics.rank_metrics(ranks).first()
    assert (row["recall_1"], row["recall_3"], row["recall_5"], row["mrr"]) == (0.25, 0.25, 0.5, round((1 + 0.25) / 4, 6))
    v = spark.createDataFrame([(1.0, 2), (3.0, 2)], "v double, w int")
    assert v.agg(metrics.weighted_mean(F.col("v"), F.col("w"))).first()[0] == 2.0
    assert v.unionByName(spark.createDataFrame([(None, 1)], "v double, w int")).agg(metrics.weighted_mean(F.col("v"), F.col("w"))).first()[0] is None


def test_state(spark):
    log = spark.createDataFrame([("a", None, 1, "x"), ("a", None, 2, "y"), ("a", "p", 1, "z")], "k string, p string, at int, v string")
    assert rows(state.latest(log, ["k", "p"], "at"), "p", "v") == [("p", "z"), (None, "y")]
    table = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    more = spark.createDataFrame([(1, "b"), (2, "c"), (None, "m")], "k int, v string")
    assert set(rows(state.upserted(table, more, ["k"]), "k", "v")) == {(1, "b"), (2, "c"), (None, "m")}
    assert set(rows(state.inserted(table, more, ["k"]), "k", "v")) == {(1, "a"), (2, "c"), (None, "n")}
    page = state.page_after(spark.createDataFrame([(1, i) for i in range(5)] + [(2, 0)], "a int, b int"), ("a", "b"), (1, 3), 2).collect()
    assert [tuple(r) for r in page] == [(1, 2), (1, 1), (1, 0)]


def test_lineage(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "id int, text string")
    print_ = lambda x: lineage.fingerprint(x, "id", F.col("text")).first()[0]
    assert print_(df) == print_(df.repartition(7)) != print_(df.where("id <> 3"))
    a = spark.createDataFrame([(1,), (1,)], "x int")
    assert rows(lineage.differences(a, a.limit(1)), "x", "side") == [(1, "left")]
    with pytest.raises(ValueError, match="bad"):
        lineage.require_empty(a, "bad")
    lineage.require_empty(a.limit(0), "bad")


def test_lane_validation(spark):
    registry = lines.registry(spark.createDataFrame([("d", 1, "커피 10% 할인\n월 최대 1만원\n주유 할인 제외\n할인 대상 안내\n그냥 글")], "document string, page int, text string"), "document").select("document", "line_id", "text")
    blank = dict.fromkeys(("target", "action", "benefit_type", "value", "unit", "condition", "cap", "period", "frequency", "exceptions"), "")
    facts = spark.createDataFrame([{"document": "d", "fact": 0} | blank | {"target": "커피", "action": "할인", "value": "10", "unit": "%", "cap": "월 최대 1만원"}, {"document": "d", "fact": 1} | blank | {"target": "주유", "action": "할인", "condition": "x"}])
    good = [("d", 0, "target", 1, 0, 2), ("d", 0, "value", 1, 3, 5), ("d", 0, "unit", 1, 5, 6), ("d", 0, "action", 1, 7, 9), ("d", 0, "cap", 2, 0, 8)]
    bad = [("d", 1, "target", 3, 0, 2), ("d", 1, "action", 3, 3, 5), ("d", 1, "action", 3, 4, 5)]
    spans = spark.createDataFrame([(d, f, n, f"P0001-L{i:04d}", a, b) for d, f, n, i, a, b in good + bad], "document string, fact int, field string, line_id string, start int, end int")
    ignored = spark.createDataFrame([("d", "P0001-L0004", "제목")], "document string, line_id string, reason string")
    got = validation.validated(facts, spans, registry, ignored)
    assert {(r["fact"], r["rule"]) for r in got.collect()} == {(1, "evidence_missing"), (1, "evidence_overlaps"), (1, "negated_action"), (1, "marker_not_mapped"), (None, "benefit_ignored")}
    documents = spark.createDataFrame([("d",), ("e",)], "document string")
    assert rows(validation.lane_verdicts(documents, got), "document", "verdict") == [("d", "blocked"), ("e", "pass")]
    first = validation.validated(facts.where("fact = 0"), spans.where("fact = 0"), registry.where("line_id < 'P0001-L0003'"), ignored.limit(0))
    assert first.count() == 0


def test_corpus_violations(spark):
    parents = spark.createDataFrame([("p1", "d", 1, 2, "text"), ("p2", "d", 3, 2, " ")], "parent_id string, document_id string, page_start int, page_end int, text string")
    children = spark.createDataFrame([("c1", "p1", "d", 1, 1, "x", False), ("c1", "p1", "e", 1, 3, "y" * 1601, False), ("c3", "p9", "d", 1, 1, "", True)], "chunk_id string, parent_id string, document_id string, page_start int, page_end int, text string, atomic boolean")
    assert set(rows(validation.corpus_violations(parents, children), "id", "rule")) == {("p2", "parent_blank"), ("p2", "parent_pages"), ("p2", "parent_without_child"), ("c1", "child_twice"), ("c1", "child_too_long"), ("c1", "other_document"), ("c1", "outside_parent"), ("c3", "orphan"), ("c3", "child_blank")}


def test_best_tables(spark):
    rows = "array<array<string>>"
    labels = spark.createDataFrame([(1, "a", [["x", "y"], ["1", "2"]]), (2, "b", [["q"]])], f"page int, label string, rows {rows}")
    tables = spark.createDataFrame([(1, 0, [["no"]]), (1, 1, [["x", "y"], ["1", "3"]]), (1, 2, [["x", "y"], ["1", "3"]])], f"page int, ordinal int, rows {rows}")
    assert rows_of(lanes.best_tables(labels, tables, ["page"], "label")) == [("a", 1, 0.75, 1.0), ("b", None, 0.0, 0.0)]


def rows_of(df):
    return sorted((r["label"], r["candidate"], r["content"], r["structure"]) for r in df.collect())


def test_benefit_windows(spark):
    paragraphs = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(["intro", "coffee 10%", "movie 5%", "x" * 3000])], "document string, page int, paragraph int, text string")
    needles = spark.createDataFrame([("d", 1, 0, "coffee"), ("d", 1, 0, "10%"), ("d", 1, 1, "coffee"), ("d", 1, 2, "%"), ("d", 1, 3, "none"), ("d", 1, 4, "movie")], "document string, page int, label int, needle string")
    got = {tuple(r["labels"]): r["text"] for r in lines.benefit_windows(paragraphs, needles, "document").collect()}
    assert got == {(0, 1): "intro\n\ncoffee 10%\n\nmovie 5%", (4,): "coffee 10%\n\nmovie 5%"}


def test_repeated_keys_in_changes(spark):
    """Of several changes of a key the last by order counts, of several inserts the first."""
    table = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, at int")
    changes = spark.createDataFrame([(1, "y", 2), (1, "z", 1), (3, "n", 5), (3, "m", 4), (None, "p", 1), (None, "q", 2)], "k int, v string, at int")
    assert set(rows(state.upserted(table, changes, ["k"], "at"), "k", "v")) == {(1, "y"), (2, "b"), (3, "n"), (None, "q")}
    assert set(rows(state.inserted(table, changes, ["k"], "at"), "k", "v")) == {(1, "a"), (2, "b"), (3, "m"), (None, "p")}


def test_following_rows(spark):
    draw = random.Random(2)
    pairs = sorted({(draw.choice(["a", "b", None]), draw.randrange(-60, 400)) for _ in range(300)}, key=str)
    df = spark.createDataFrame(pairs, "g string, n long")
    want = {}
    for g in ("a", "b", None):
        its = sorted(n for x, n in pairs if x == g)
        want |= {(g, n): m for n, m in zip(its, [*its[1:], None], strict=True)}
    for width in (1, 16, 10_000):
        got = ranking.following(df, "g", "n", width).collect()
        assert {(r["g"], r["n"]): r["next"] for r in got} == want and len(got) == len(want)


def test_nearest_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 40)
    monkeypatch.setattr(blocks, "QUERY_ROWS", 3)
    draw = np.random.default_rng(1)
    X = draw.standard_normal((150, 8)).astype(np.float32)
    X[3] = X[7] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "vec_id long, embedding array<float>")
    for measure, score in (("l2", lambda q: ((X - q) ** 2).sum(axis=1, dtype=float)), ("cosine", lambda q: -np.nan_to_num(X.astype(float) @ q / np.linalg.norm(X.astype(float), axis=1) / max(1e-300, np.linalg.norm(q.astype(float)))))):
        got = vectors.nearest(df.where("vec_id % 20 = 0 OR vec_id = 3"), df, 6, measure).collect()
        for q in [*range(0, 150, 20), 3]:
            s = np.round(score(X[q]), 9)
            want = sorted(range(150), key=lambda i: (s[i], i))[:6]
            assert [r["doc"] for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == want, (measure, q)


def test_malformed_line_ids_are_passed_over(spark):
    df = spark.createDataFrame([(1, ["P0001-L0004"], ["P0001-L0006"]), (2, ["P0001-L0004", "P0001-Lxxxx"], ["P0001-L0009"]), (3, ["", "P0001"], ["P0001-L0004"]), (4, ["P0001-Lxxxx"], ["P0001-Lxxxx"]), (5, None, ["P0001-L0004"])], "i int, a array<string>, b array<string>")
    got = {r["i"]: r["x"] for r in df.select("i", lines.evidence_near(F.col("a"), F.col("b")).alias("x")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: None}
