import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import lexical
from docloom.sources import readers, writers
from docloom.streaming import turns


def test_listing_and_manifest(spark, tmp_path):
    for issuer, name in (("B", "two"), ("a", "One"), ("a", "three")):
        (tmp_path / "docs" / issuer).mkdir(parents=True, exist_ok=True)
        (tmp_path / "docs" / issuer / f"{name}.pdf").write_bytes(name.encode())
    (tmp_path / "docs" / "a" / "note.txt").write_text("no")
    got = readers.documents_in(spark, str(tmp_path / "docs")).collect()
    assert [r["document_id"] for r in got] == ["a/One", "a/three", "B/two"]
    assert [r["document_id"] for r in readers.documents_in(spark, str(tmp_path / "docs"), issuers=["a"], limit=1).collect()] == ["a/One"]
    rows = [{"document_id": "z", "path": "p", "sha256": "s"}, {"document_id": "y", "path": "q", "sha256": "t"}]
    for i, body in enumerate((rows, {"documents": rows})):
        (tmp_path / f"m{i}.json").write_text(json.dumps(body))
        assert [r["document_id"] for r in readers.manifest(spark, str(tmp_path / f"m{i}.json")).collect()] == ["y", "z"]
    (tmp_path / "twice.json").write_text(json.dumps(rows + rows))
    with pytest.raises(ValueError, match="twice"):
        readers.manifest(spark, str(tmp_path / "twice.json"))


def test_json_lines(spark, tmp_path):
    assert readers.json_lines(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").count() == 2
    assert writers.write_json_lines(spark.range(7), str(tmp_path / "out")) == 7


def test_pages(spark):
    texts = spark.createDataFrame([("d", "[page 2]\nb\n[page 1]\na\n[page 2]\nc")], "id string, text string")
    pages = readers.pages_of(texts, "id", "plain")
    assert pages.count() == 3 and [r["page"] for r in readers.repeated_pages(pages, "id").collect()] == [2]
    documents = spark.createDataFrame([("d", 3)], "document_id string, page_count int")
    given = spark.createDataFrame([("d", [(0, "x"), (4, "beyond")])], "document_id string, pages array<struct<index:int,markdown:string>>")
    filled = readers.filled_pages(documents, readers.indexed_pages(given)).orderBy("page").collect()
    assert [(r["page"], r["status"], r["text"]) for r in filled] == [(1, "success", "x"), (2, "missing", ""), (3, "missing", "")]
    elements = "array<struct<id:int,category:string,page:int,content:struct<markdown:string,html:string,text:string>,coordinates:array<struct<x:double,y:double>>>>"
    response = spark.createDataFrame([("d", [(1, "heading1", 1, ("# T", "", ""), [(0.1, 0.2), (0.3, 0.1)]), (2, "table", None, ("", "<table>", "x"), None), (3, "paragraph", 2, (" ", None, "p"), [])])], f"document_id string, elements {elements}")
    got = {r["page"]: r for r in readers.element_pages(response).collect()}
    assert got[1]["text"] == "# T\n\n<table>" and len(got[1]["tables"]) == 1 and got[2]["text"] == "p"
    assert tuple(got[1]["blocks"][0]["bbox"]) == (0.1, 0.1, 0.3, 0.2)


def test_events_and_gold(spark):
    events = spark.createDataFrame([(1, 1, "usage", "5"), (1, 2, "usage", "7"), (1, 3, "message", "m")], "run int, n int, type string, v string")
    assert readers.last_event(events, ["run"], "n", F.col("type") == "usage", F.col("v"), "usage").first()["usage"] == "7"
    label = "array<struct<id:string,page_num:int,surface_text:string,context_terms:array<string>,critical:boolean>>"
    other = "array<struct<id:string,page_num:int,value:string,context_terms:array<string>,critical:boolean>>"
    gold = spark.createDataFrame([("d", [("n1", 1, "10%", ["a"], True)], [("n1", 1, "other", ["b"], False), ("f1", 2, "v", [], False)])], f"document_id string, numeric_labels {label}, field_labels {other}")
    assert {(r["id"], r["kind"], r["expected_answer"]) for r in readers.gold_queries(gold).collect()} == {("n1", "numeric", "10%"), ("f1", "field", "v")}


def test_releases(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    make = lambda n: spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(n)], "chunk_id string, text string")
    vectors = lambda df: df.select("chunk_id", writers.pseudo_embedding(F.col("text"), 8).alias("embedding"))
    first = writers.publish(make(3), vectors(make(3)), root)
    assert writers.publish(make(3).repartition(2), vectors(make(3)), root) == first
    second = writers.publish(make(4), vectors(make(4)), root)
    assert first != second
    writers.activate(spark, root, first)
    writers.activate(spark, root, second)
    assert writers.active(spark, root) == second
    writers.roll_back(spark, root, first)
    assert writers.active(spark, root) == first
    assert [r["release_id"] for r in writers.active_history(spark, root).orderBy("ordinal").collect()] == [first, second, first]
    assert readers.release_chunks(spark, root, first, 3).count() == 3
    with pytest.raises(ValueError, match="holds"):
        readers.release_chunks(spark, root, first, 5)
    with pytest.raises(ValueError, match="never"):
        writers.roll_back(spark, root, "rel_none")
    with pytest.raises(ValueError, match="other rows"):
        writers.write_once(make(5), f"{root}/releases/{first}/chunks", "chunk_id", F.col("text"))
    with pytest.raises(ValueError, match="no embedding"):
        writers.publish(make(6), vectors(make(5)), root)


def test_index_and_embeddings(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], "id int, text string")
    index = writers.write_postings(docs, "id", lexical.ascii_tokens(F.col("text")), str(tmp_path / "index"))
    assert {(r["term"], r["df"]) for r in index.terms.collect()} == {("a", 1), ("b", 2)}
    rows = spark.createDataFrame([(1, "x", [1.0], "m"), (2, "yy", None, None), (3, "z", [0.0], "old")], "id int, text string, embedding array<float>, embedding_model string")
    got = {r["id"]: (r["embedding"], r["embedding_model"]) for r in writers.embed_missing(rows, lambda t: [[float(len(x))] for x in t], "m", 1).collect()}
    assert got == {1: ([1.0], "m"), 2: ([2.0], "m"), 3: ([1.0], "m")}
    ids = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2)], "chunk_id string, ordinal int")
    table = spark.createDataFrame([("a", [1.0, float("nan")]), ("b", [1.0, 2.0])], "chunk_id string, embedding array<double>")
    assert [(r["chunk_id"], r["finite"]) for r in readers.vectors_for(ids, table).collect()] == [("b", True), ("a", False), ("c", False)]


def test_structured_tables(spark, tmp_path):
    documents = spark.createDataFrame([("d",)], "document_id string")
    facts = spark.createDataFrame([("f", "v1"), ("g", "v2")], "fact_id string, contract string")
    with pytest.raises(ValueError, match="several"):
        writers.structured_tables(documents, facts, {}, str(tmp_path / "s"))
    writers.structured_tables(documents, facts.limit(1), {"a": ["A b"]}, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/target_aliases")).first()["alias_normalized"] == "ab"


EVENTS = [(1, 0.0, "x", "start"), (1, 10.0, "y", "start"), (1, 20.0, "x", "complete"), (1, 30.0, "x", "complete"), (2, 0.0, "x", "start"), (2, 700.0, "y", "start"), (2, 710.0, "x", "complete"), (2, 2000.0, "y", "complete")]
WANT = {(1, 0.0): "accepted", (1, 10.0): "busy", (1, 20.0): "accepted", (1, 30.0): "stale", (2, 0.0): "accepted", (2, 700.0): "took_over", (2, 710.0): "stale", (2, 2000.0): "expired"}


def test_turns_as_table_and_stream(spark, tmp_path):
    events = spark.createDataFrame(EVENTS, "conv_id long, at double, attempt_id string, kind string")
    assert {(r["conv_id"], r["at"]): r["outcome"] for r in turns.outcomes(events).collect()} == WANT
    for part, where in (("a", "at <= 10"), ("b", "at > 10")):  # state is kept between batches
        events.where(where).coalesce(1).write.parquet(str(tmp_path / "in" / part))
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in" / "*"))
        turns.resume(turns.outcome_stream(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["conv_id"], r["at"]): r["outcome"] for r in got.collect()} == WANT and got.count() == len(EVENTS)


def test_requests_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "r"), (1, "r"), (2, "r")], "conv_id long, request_id string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    turns.resume(turns.once_per_request(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_a_run_that_dies_leaves_no_half_table(spark, tmp_path):
    path = f"file://{tmp_path}/once"
    df = spark.range(5).select(F.col("id").alias("k"), F.lit("v").alias("v"))

    def dies(own):
        df.write.parquet(own)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        writers.put_in_place(spark, path, dies)
    assert not writers.exists(spark, path)
    assert writers.write_once(df, path, "k", F.col("v")) and spark.read.parquet(path).count() == 5
    assert not writers.write_once(df, path, "k", F.col("v"))
    with pytest.raises(ValueError, match="other rows"):
        writers.write_once(df.limit(4), path, "k", F.col("v"))
    # two at once: the second finds the place taken when it is done
    other = f"file://{tmp_path}/raced"

    def overtaken(own):
        df.write.parquet(own)
        df.limit(2).write.parquet(other)

    assert not writers.put_in_place(spark, other, overtaken) and spark.read.parquet(other).count() == 2


def test_the_pointer_is_replaced_in_one_step(spark, tmp_path):
    path = f"file://{tmp_path}/active.json"
    for text in ("one", "two"):
        writers.write_text(spark, path, text)
        assert writers.read_text(spark, path) == text
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["active.json"]


def test_numbers_of_the_history_are_given_once(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    chunks = spark.createDataFrame([("c1", "t")], "chunk_id string, text string")
    release = writers.publish(chunks, spark.createDataFrame([("c1", [0.5])], "chunk_id string, embedding array<float>"), root)
    writers.activate(spark, root, release)
    # another writer has taken the next number, which a count of an older listing would give again
    assert writers._create(spark, f"{root}/active_history/{1:012d}.json", '{"ordinal": 1, "release_id": "other"}')
    assert not writers._create(spark, f"{root}/active_history/{1:012d}.json", "{}")
    writers.activate(spark, root, release)
    assert sorted(r["ordinal"] for r in writers.active_history(spark, root).collect()) == [0, 1, 2]


def test_the_stored_index_follows_its_files(spark, tmp_path):
    docs, tokens = f"{tmp_path}/docs", lexical.ascii_tokens(F.col("text"))
    read = lambda: writers.stored_postings(spark.read.parquet(docs), "id", tokens, f"file://{tmp_path}/store")
    spark.createDataFrame([(1, "a b a"), (2, "b")], "id long, text string").write.parquet(docs)
    assert {(r["term"], r["doc"], r["tf"]) for r in read().postings.collect()} == {("a", 1, 2), ("b", 1, 1), ("b", 2, 1)}
    assert {r["df"] for r in read().terms.where("term = 'b'").collect()} == {2}
    stored = [p.name for p in (tmp_path / "store").iterdir() if not p.name.startswith(".")]
    assert len(stored) == 1
    spark.createDataFrame([(3, "c")], "id long, text string").write.mode("append").parquet(docs)
    assert read().corpus.first()["n_docs"] == 3


def test_stored_postings_are_told_apart(spark, tmp_path, monkeypatch):
    """Another tokenizer, filter, id or format of the same files has an index of its own."""
    path, store = f"{tmp_path}/docs", f"file://{tmp_path}/store"
    spark.createDataFrame([(1, "Ab cd", "x"), (2, "ab ef", "x"), (3, "cd", "y")], "id long, text string, src string").coalesce(1).write.parquet(path)
    words, letters = lexical.ascii_tokens(F.col("text")), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]"), F.lit(0))
    docs = lambda: spark.read.parquet(path)
    size = lambda d, t=words, i="id": writers.stored_postings(d, i, t, store).corpus.first()["n_docs"]
    assert size(docs().where("src = 'x'")) == 2
    assert size(docs()) == 3
    assert size(docs().where("src = 'y'")) == 1
    terms = lambda t: {r["term"] for r in writers.stored_postings(docs(), "id", t, store).terms.collect()}
    assert terms(words) == {"ab", "cd", "ef"} and terms(letters) == set("abcdef")
    root = writers.postings_root(docs(), "id", words, store)
    assert root == writers.postings_root(docs(), "id", words, store)
    assert len({root, *(writers.postings_root(d, i, t, store) for d, i, t in ((docs(), "src", words), (docs(), "id", letters), (docs().where("id > 1"), "id", words)))}) == 4
    monkeypatch.setattr(writers, "POSTINGS_FORMAT", 0)
    assert writers.postings_root(docs(), "id", words, store) != root


def test_only_rows_of_files_have_a_stored_index(spark, tmp_path):
    path = f"{tmp_path}/docs"
    docs = spark.createDataFrame([(1, "ab")], "id long, text string")
    docs.write.parquet(path)
    own = F.udf(lambda t: t.split(), "array<string>")
    for df, tokens in ((docs, F.split("text", " ")), (spark.read.parquet(path).join(docs.select("id"), "id"), F.split("text", " ")), (spark.read.parquet(path), own("text"))):
        with pytest.raises(ValueError):
            writers.plan_text(df.select("id", tokens))
