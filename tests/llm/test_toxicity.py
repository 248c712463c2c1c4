import contextlib
import io
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import toxic_cnn as tc
from docloom.llm.q_toxicity import op12_toxicity



def test_held_out_documents(spark):
    """Learnt from four fifths of the labels, judged on the rest: toxic ones are caught, clean ones left alone."""
    got = op12_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    toxic, caught = got.toxic == 1, got.predicted == 1
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == caught).all()
    assert (caught & toxic).sum() / caught.sum() >= 0.95
    assert (caught & toxic).sum() / toxic.sum() >= 0.75  # a share of these labels has no cause in the text
    order = got.score.rank()
    auc = (order[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc >= 0.9


def made(n=900, seed=1):
    """Texts of two languages with insults of a common stem, some very long, some of a phrase of two words that are harmless alone."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ("the of and is", "der die und ist")[i % 2].split()
        words = [draw.choice(lang) if draw.random() < 0.4 else f"w{draw.randrange(500)}" for _ in range(draw.choice([5, 60, 900]))]
        toxic = i % 5 == 0
        at = draw.randrange(len(words))
        if toxic:
            words[at] = f"grumbl{draw.randrange(2000)}" if i % 3 else "red herring"
        elif i % 5 == 1:
            words[at] = draw.choice(["red", "herring"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.createDataFrame(made(), "doc_id long, text string, toxic int")
    return docs, tc.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))


def test_stems_and_phrases(spark, fitted):
    model = fitted[1]
    rows = made(400, seed=2)
    score = model.score([t.encode() for _, t, _ in rows])
    y = np.array([r[2] for r in rows])
    assert (score[y == 1] >= 0.5).mean() >= 0.9 and (score[y == 0] < 0.5).mean() >= 0.95


def test_only_the_text_counts(spark, fitted):
    docs, model = fitted
    run = lambda d: {r["doc_id"]: r["score"] for r in tc.score(d, model).collect()}
    plain = docs.select("doc_id", "text")
    assert run(plain) == run(plain.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "toxic": F.lit(1)}).repartition(7))


def test_forward_by_slices_and_by_loops(spark, fitted, monkeypatch):
    net = fitted[1].network
    texts = [b"", b"one", b"one two", b"a b c d e f g " * 40, b"!!", b"x"]
    ids, begins = tc.word_ids(texts)
    want = []
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        n = max(1, b - a)
        X = np.zeros((n + 2, tc.SIZE))
        X[: b - a] = net.emb[ids[a:b]].astype(float).sum(axis=1)
        H = np.concatenate([sum(X[j : j + n] @ f[j].astype(float) for j in range(w)) for w, f in zip(tc.WIDTHS, net.filters, strict=True)], axis=1)
        want.append(np.maximum(0, H.max(axis=0) + net.bias) @ net.out + net.shift)
    for places in (1 << 16, 7, 1):
        monkeypatch.setattr(tc, "PLACES", places)
        assert np.allclose(net.logits(ids, begins), want, atol=1e-4)


def test_step_follows_the_gradient():
    net, draw = tc.Network(seed=3), random.Random(5)
    texts = [" ".join(f"w{draw.randrange(30)}" for _ in range(draw.randrange(12))).encode() for _ in range(16)]
    ids, begins = tc.word_ids(texts)
    y, weight = np.array([i % 2 for i in range(16)], float), np.ones(16)
    loss = lambda: np.logaddexp(0, np.where(y == 1, -1, 1) * net.logits(ids, begins)).mean()
    before = loss()
    for _ in range(150):
        net.step(ids, begins, y, weight, 0.05)
    assert loss() < 0.2 * before and (net.emb[0] == 0).all()


def test_words():
    ids, begins = tc.word_ids([b"Idiot! idiot, IDIOTS", b"", "größe".encode()])
    assert begins.tolist() == [0, 3, 3, 4] and (ids > 0).all()
    assert (ids[0] == ids[1]).all() and ids[0, 0] != ids[2, 0] and (ids[0, 1:] == ids[2, 1:]).all()
    table = tc.language_table()
    assert tc.languages(*tc.word_ids([b"the cat is on the mat", "der Hund und die Katze".encode(), b"zzz", b"", "le chat est sur la table".encode(), "el perro y los gatos".encode()]), table).tolist() == [1, 2, 0, 0, 3, 4]


def test_threshold():
    z, y = np.array([-3.0, -1, 2, 3, 4]), np.array([0, 0, 1, 1, 0.0])
    assert tc.threshold(z, y, np.ones(5)) == 0.5
    assert tc.threshold(z, y, np.array([1, 1, 0.1, 0.1, 5])) == 5  # nothing is worth catching
    assert tc.threshold(np.zeros(4), np.array([1, 1, 1, 0.0]), np.ones(4)) == -1


def test_a_threshold_for_each_language():
    draw = np.random.default_rng(1)
    texts = []
    for i in range(1200):
        other = i // 4 % 2
        toxic = int(draw.random() < 0.5)
        words = " ".join(["der die und"] * other or ["the of and"]) + (" vile" if toxic or (other and draw.random() < 0.5) else " mild") + (" grob" if toxic and other else "")
        ids, _ = tc.word_ids([words.encode()])
        texts.append((ids.tobytes(), toxic))
    model = tc.Toxicity(texts, (600, 600))
    assert len(set(model.cuts[1:3])) == 2
    assert (model.score([b"the of and vile", b"der die und grob"]) >= 0.5).all() and (model.score([b"the of and mild", b"der die und mild"]) < 0.5).all()


def test_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = tc.score(odd, tc.fit(odd, none)).collect()
    assert len(got) == odd.count() and {(r["score"], r["predicted"]) for r in got} == {(0.0, 0)}
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100, 140)] + [(1, None), (None, 1), (4, 0), (4, 1), (2, 0)], "doc_id long, toxic int")
    model = tc.fit(odd, labels)
    assert model.fitted
    named = odd.withColumns({"score": F.lit("x"), "y": F.lit(1), "words": F.lit("w"), "id": F.col("doc_id")})
    got = tc.score(named, model)
    assert set(got.columns) == set(named.columns) | {"predicted"} and got.schema["score"].dataType.simpleString() == "double"
    rows = got.collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["y"] == 1 and r["words"] == "w" for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] in (1, 2, 3)} == {rows[0]["score"] if rows[0]["doc_id"] == 1 else next(r["score"] for r in rows if r["doc_id"] == 1)}
    assert tc.score(empty, model).count() == 0 and tc.score(empty, tc.fit(empty, labels)).count() == 0
    assert tc.score(odd, tc.fit(odd, spark.createDataFrame([(4, 1)], "doc_id long, toxic int"))).agg(F.min("score")).first()[0] == 1.0


def test_every_label_is_learnt_from(spark, monkeypatch):
    """In several parts, whose copies are averaged; the layout plays no part."""
    monkeypatch.setattr(tc, "PART", 600)
    rows = made(3000, seed=4)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learnt = []
    epochs = tc._epochs
    monkeypatch.setattr(tc, "_epochs", lambda rows, net, parts, *a: learnt.append((rows.count(), parts)) or epochs(rows, net, parts, *a))
    model = tc.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert len(learnt) == tc.ROUNDS and all(2100 < n < 2400 and parts == 4 for n, parts in learnt)
    again = tc.fit(docs.repartition(5).select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert np.array_equal(model.network.emb, again.network.emb) and np.array_equal(model.cuts, again.cuts)
    score, y = model.score([t.encode() for _, t, _ in made(400, seed=5)]), np.array([r[2] for r in made(400, seed=5)])
    assert (score[y == 1] >= 0.5).mean() >= 0.8 and (score[y == 0] < 0.5).mean() >= 0.9


def test_no_labelled_document_is_left_out_of_the_join(spark):
    ids = spark.range(0, 30_000).select((F.col("id") * 7919).alias("id"))
    got = tc._maybe_in(ids, ids.where("id % 5 = 0"))
    assert got.where("id % 5 = 0").count() == 6000 and got.count() < 6200


def test_bounded_sample(spark):
    rows = made(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    few = tc.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), toxic=10, clean=20, words=100)
    assert few.prior == 0.2
    a, b = (tc.fit(d.select("doc_id", "text"), docs.select("doc_id", "toxic")).score([b"the red herring", b""]) for d in (docs, docs.repartition(9)))
    assert np.array_equal(a, b)


def test_words_are_dealt_once(spark, monkeypatch):
    """The words of labelled documents are grouped where the join has put them, without a second shuffle; of several rows of an id one is learnt from."""
    rows = made(80)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(0, "zz"), (0, "aa")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    plans = []
    monkeypatch.setattr(tc, "staged", lambda df, name: plans.append(df) or df)
    monkeypatch.setattr(tc.Toxicity, "__init__", lambda self, texts, *_: setattr(self, "texts", texts))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        model = tc.fit(docs, labels)
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            plans[0].explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "MapInArrow" in out.getvalue() and not re.search(r"hashpartitioning\(id#\d+L?, y#", out.getvalue())
    assert len(model.texts) == len(rows)
