import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import gru_lm
from docloom.llm.gru_lm import Network, Trainer, Words, score
from docloom.llm.q_lm import op7_lm

MARGIN = 0.2


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def check_base(rows, got):
    """The base, the split and the counts by plain counting."""
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    c = Counter(t for d, x in rows if not held(d) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    want = sorted(((d, held(d), len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x)), 5)) for d, x in rows), key=str)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got), key=str) == want


def test_base_and_model_at_registered_settings(spark):
    """Held-out text: the model gains at least MARGIN (log10 a token) on the base over all tokens, and 19 of 20 documents gain."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = op7_lm(spark, "/root/testdata/sf0.01").collect()
    check_base([tuple(r) for r in docs.collect()], got)
    held = [r for r in got if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert gain >= MARGIN
    assert sum(r["score"] > r["base_score"] for r in held) >= 0.95 * len(held)


def test_layout_plays_no_part(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    one, two = ({r["doc_id"]: r["score"] for r in score(d).collect()} for d in (docs.coalesce(1), docs.repartition(7, "text")))
    assert all(math.isclose(one[d], two[d], rel_tol=1e-6) for d in one) and len(one) == len(two)


def test_small_head_joins_the_rest(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    check_base([tuple(r) for r in docs.collect()], score(docs, head=50, known=20, classes=5).collect())


def test_learns_from_every_training_document(spark, monkeypatch):
    taught: list[str] = []
    monkeypatch.setattr(gru_lm, "averaged", lambda docs, *_: taught.extend(r["text"] for r in docs.collect()))
    texts = [f"w{i % 7} own{i}" for i in range(40)]
    gru_lm.language_model(spark.createDataFrame(list(enumerate(texts)), "row_key long, text string"))
    assert sorted(taught) == sorted(texts)


def test_lanes_see_every_token_once_and_carry_the_state(small, monkeypatch):
    """Documents of all lengths, one far longer than the rest."""
    seen, states = Counter(), []
    step = small.gradients

    def gradients(h, X, Y, reset):
        seen.update(Y.ravel().tolist())
        states.append((X[0] != 0, np.abs(h).sum(axis=1) > 0))
        return step(h, X, Y, reset)

    monkeypatch.setattr(small, "gradients", gradients)
    draw = np.random.default_rng(7)
    docs = [np.append(draw.integers(1, small.words.known + 1, n), 0).astype(np.int32) for n in [*draw.integers(0, 60, 400), 20_000, 900, 0]]
    trainer = Trainer(small, 40_000, lanes=16)
    for d in docs:
        trainer.add(d)
    trainer.finish()
    assert seen == Counter(np.concatenate(docs).tolist()) and trainer.tokens == sum(map(len, docs))
    inside, alive = (np.concatenate(x) for x in zip(*states, strict=True))
    assert alive[inside].mean() > 0.9  # within a document a window starts from the state before it, save after a remainder is dealt
    assert trainer.t < 1500  # the long remainder didn't run in one lane


def test_a_head_smaller_than_the_highest_level(spark):
    counts = spark.range(5000).select(F.concat(F.lit("w"), "id").alias("word"), F.lit(1).cast("long").alias("c"))
    assert 0.7 * 1000 < len(gru_lm.head_words(counts, 1000)) <= 1000
    assert len(gru_lm.head_words(counts, 5000)) == 5000 and gru_lm.head_words(counts.where("c > 1"), 9) == []


def test_odd_rows(spark, odd, odd_rows, empty):
    got = score(odd.withColumnRenamed("lang", "score"), share=1).collect()
    check_base([(i, t) for i, t, *_ in odd_rows], got)
    assert all(math.isfinite(r["score"]) for r in got)
    assert score(empty).count() == 0
    alone = score(spark.createDataFrame([(4, "a b")], "doc_id long, text string")).collect()  # crc32('4') mod 5: either side
    assert len(alone) == 1 and math.isfinite(alone[0]["score"])


@pytest.fixture
def small():
    words = Words(["", *"abcdefghij"], [30, 25, 20, 15, 10, 8, 6, 4, 3, 2, 1], 124, 11, 8, 3)
    net = Network(words, hidden=4, seed=1)
    draw = np.random.default_rng(2)
    for n, a in net.p.items():
        net.p[n] = (a + 0.3 * draw.standard_normal(a.shape)).astype(np.float64)
    return net


def test_a_distribution(small):
    """Over known tokens and the class of the rest, probabilities sum to one."""
    S = np.random.default_rng(1).standard_normal((5, 4))
    for s in S:
        logp = small.output(np.repeat(s[None], small.words.known + 1, axis=0), np.arange(small.words.known + 1))
        assert abs(np.exp(logp).sum() - 1) < 1e-9


def test_gradients(small):
    """Backpropagation through the window against differences."""
    draw = np.random.default_rng(3)
    steps, lanes = 5, 3
    Y = draw.integers(0, small.words.known + 1, (steps, lanes)).astype(np.int32)
    X = draw.integers(0, small.words.known + 1, (steps, lanes)).astype(np.int32)
    reset = np.zeros((steps, lanes), bool)
    reset[0], reset[2, 1] = True, True
    h = np.zeros((lanes, 4))

    def loss():
        S, _, _ = small.forward(h, X, reset)
        return -small.output(S.reshape(-1, 4).astype(float), Y.ravel()).sum() / Y.size

    grads, _, _ = small.gradients(h, X, Y, reset)
    for n, a in small.p.items():
        flat, its = a.reshape(-1), np.asarray(grads[n]).reshape(-1)
        for i in draw.integers(0, len(flat), 6):
            was, eps = flat[i], 1e-3
            flat[i] = was + eps
            up = loss()
            flat[i] = was - eps
            down = loss()
            flat[i] = was
            assert abs((up - down) / (2 * eps) - its[i]) < 2e-3, (n, i)


def test_state_is_carried_across_windows(small, monkeypatch):
    ids = [np.array([1, 2, 3, 4, 5, 6, 7, 0] * 5), np.array([2, 0]), np.array([0])]
    whole = gru_lm.score_documents(small, ids)
    monkeypatch.setattr(gru_lm, "SCORE_WINDOW", 3)
    assert np.allclose(gru_lm.score_documents(small, ids), whole, atol=1e-4)
    draw = np.random.default_rng(1)
    many = [np.append(draw.integers(1, 9, n), 0) for n in [*draw.integers(0, 40, 60), 500, 0, 90]]
    scorer = gru_lm.Scorer(small, lanes=4)
    for i, x in enumerate(many):
        scorer.add(i, x)
    early = dict(scorer.ready())
    scorer.finish()
    got = early | dict(scorer.ready())
    assert early and sorted(got) == list(range(len(many)))
    assert np.allclose([got[i] for i in range(len(many))], [gru_lm.score_documents(small, [x])[0] for x in many], atol=1e-3)
    assert np.allclose([gru_lm.score_documents(small, [x])[0] for x in ids], whole, atol=1e-4)


def test_states_and_answers_by_hand(small):
    """Gates and softmaxes whose arrays run along the lanes, against single rows; answers beyond what exp holds; words among the network's own."""
    draw = np.random.default_rng(6)
    X, Y = draw.integers(0, 9, (5, 3)), draw.integers(0, 9, (5, 3))
    h, reset = draw.standard_normal((3, 4)) / 3, X == 0
    S, last, _ = small.states(h, X, reset)
    p, words = small.p, small.words
    for lane in range(3):
        now = h[lane]
        for t in range(5):
            now = now * (not reset[t, lane])
            x, g = p["E"][X[t, lane]] + p["B"], now @ p["U"]
            z, r = (1 / (1 + np.exp(-(x[a : a + 4] + g[a : a + 4]))) for a in (0, 4))
            n = np.tanh(x[8:] + r * g[8:])
            now = n + z * (now - n)
            assert np.allclose(S[:, t, lane], now, atol=1e-5)
        assert np.allclose(last[lane], now, atol=1e-5)
    for far in (1, 400):
        small.p = p | {"Wo": p["Wo"] * far, "Wc": p["Wc"] * far}
        for s, y, got in zip(S.reshape(4, -1).T, Y.ravel(), small.answers(S.reshape(4, -1), Y.ravel()), strict=True):
            c = words.of[y]
            logits = s @ small.p["Wc"] + p["bc"]
            want = logits[c] - np.logaddexp.reduce(logits)
            if c < words.classes:
                its = slice(words.starts[c], words.starts[c + 1])
                logits = small.p["Wo"][its] @ s + p["bo"][its]
                want += logits[y - words.starts[c]] - np.logaddexp.reduce(logits)
            assert np.isclose(got, want, rtol=1e-4, atol=1e-4)
    for text in (b"", b"a B zz", b"h i j k a"):
        assert (words.own_ids(text) == np.minimum(words.ids(text)[0], words.known)).all()
