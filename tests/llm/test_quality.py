import numpy as np
from pyspark.sql import functions as F

from docloom.llm import cotrain
from docloom.llm.q_quality import op3_quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    """Fitted on the labels of four in five, judged on the rest."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = cotrain.fit(docs, labels.where(~fold))
    assert model.fitted and model.given > 0  # the views have taught each other
    got = cotrain.score(docs, model).join(labels.where(fold), "doc_id").select("quality", "keep", "quality_score", "toxic").toPandas()
    good = got.quality == 1
    assert (got.keep == good).mean() >= 0.95
    assert got.keep[good].mean() >= 0.98  # clean documents stay
    assert abs(got.quality_score.mean() - good.mean()) < 0.1
    assert np.isfinite(got.quality_score).all() and got.quality_score.between(0, 1).all()


def test_reruns_agree(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    run = lambda d: sorted((r["doc_id"], round(r["quality_score"], 9)) for r in cotrain.score(d, cotrain.fit(d, labels)).collect())
    assert run(docs) == run(docs.repartition(7))


def plain_hash(word: bytes) -> int:
    """The 64-bit hash of a word by its definition: a polynomial of its bytes, then the finaliser."""
    mask, base, h, p = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0, 1
    for c in word.lower():
        h = (h + (c + 1) * p) & mask
        p = p * base & mask
    return plain_mix((h + len(word) * 0xD6E8FEB86659FD93) & mask)


def plain_mix(h: int) -> int:
    mask = (1 << 64) - 1
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
    h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
    return h ^ h >> 31


def plain_grams(text: bytes) -> list[int]:
    words = [plain_hash(w) for w in text.split()]
    pairs = [plain_mix((a * 0x9E3779B97F4A7C15 + b) & ((1 << 64) - 1)) for a, b in zip(words, words[1:], strict=False)]
    return [h % (1 << 14) for h in words + pairs]


def plain_shape(t: bytes) -> list[float]:
    """Shares of classes of characters, and counts of words and lines, by loops."""
    words = t.split()
    if not words:
        return [0.0] * cotrain.N_SHAPE
    classes = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,;:'\"()-", "!?", "#$%&*@^~", "|", "{}[]<>=/\\_+"]
    shares = [sum(chr(c) in k for c in t if c < 128) / len(t) for k in classes]
    high = sum(c >= 128 for c in t) / len(t)
    n, distinct = len(words), len(set(words))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    roots = [x**0.5 for x in [1 - sum(shares) - high, *shares, high]]
    return [*roots, 1.0, np.log(1 + n), len(t) / n / 10, distinct / n, np.log(distinct) / np.log(n + 1), again**0.5, np.log(1 + len(t) / (t.count(b"\n") + 1))]


def test_features_against_loops(spark, sf):
    """Shapes, buckets of words and pairs, and their odds, of all documents by other code."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "labels"))
    label = {r["doc_id"]: r["quality"] for r in labels if r["quality"] is not None}
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs}
    known = [i for i in sorted(text) if i in label]
    assert len(known) >= cotrain.LEAST_LABELLED
    half = spark.createDataFrame([(i,) for i in known], "i long").select("i", (F.pmod(F.xxhash64("i", F.lit(37)), F.lit(2)) == 0).alias("c")).collect()
    counted = [r["i"] for r in half if r["c"]]
    odds = {}
    many = [sum((label[i] > 0) == y for i in counted) for y in (False, True)]
    for y in (False, True):
        seen: dict = {}
        for i in counted:
            if (label[i] > 0) == y:
                for g in set(plain_grams(text[i])):
                    seen[g] = seen.get(g, 0) + 1
        for g in range(1 << 14):
            odds[g] = odds.get(g, 0) + (1 if y else -1) * np.log((seen.get(g, 0) + 2) / (many[y] + 4))
    model = cotrain.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert np.allclose(model.odds, [odds[g] for g in range(1 << 14)], atol=1e-12)
    got = cotrain.featurized(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), model.odds).select("doc_id", "_text").collect()
    assert len(got) == len(docs)
    for r in got:
        t = text[r["doc_id"]]
        w = sorted(odds[g] for g in plain_grams(t))
        k = max(1, len(w) // 10)
        want = [*plain_shape(t), *((sum(w) / len(w), sum(w[:k]) / k) if w else (0.0, 0.0))]
        assert np.allclose(np.frombuffer(r["_text"], "<f4"), want, atol=2e-5)


def test_scores_follow_from_the_views(spark, sf):
    """The query's scores by another logistic code: each view's answer, calibrated, and both combined."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = cotrain.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    line = lambda m, x: sum((a - b) / c * w for a, b, c, w in zip(x, m.mean, m.scale, m.w, strict=False)) + m.w[-1]
    squash = lambda z: 1 / (1 + np.exp(-max(-30, min(30, z))))
    rows = {r["doc_id"]: r for r in cotrain.featurized(docs, model.odds).select("doc_id", "_text", "_meta").collect()}
    for r in op3_quality(spark, sf).collect():
        views = [np.frombuffer(rows[r["doc_id"]][c], "<f4").astype(float) for c in ("_text", "_meta")]
        z = [line(c, [max(-30, min(30, line(m, v)))]) for m, c, v in zip(model.models, model.calibration, views, strict=True)]
        z = [max(-30, min(30, x)) for x in z]
        both = squash(line(model.combined, z)) if views[0].any() else squash(z[1])
        assert np.allclose([r["quality_score"], r["text_score"], r["meta_score"]], [both, squash(z[0]), squash(z[1])], atol=1e-9)
        assert r["keep"] == (r["quality_score"] >= 0.5)


def test_words_alone_tell_the_classes(spark):
    """Texts of one shape and no metadata: only their words differ."""
    draw = np.random.default_rng(3)
    good, bad = [f"g{i:03d}" for i in range(60)], [f"b{i:03d}" for i in range(60)]
    both = [f"c{i:03d}" for i in range(300)]
    rows = []
    for i in range(1200):
        own = good if i % 2 else bad
        rows.append((i, " ".join(draw.choice(both, 45).tolist() + draw.choice(own, 5).tolist()), None, None, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(800)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in cotrain.score(docs, cotrain.fit(docs, labels)).collect()}
    assert sum(got[i] == bool(i % 2) for i in range(800, 1200)) >= 0.9 * 400


def test_repeated_ids_give_one_row_to_learn_from(spark):
    rows = [(i % 8, f"text {i} " * (i % 5 + 1), "en", "a", 10) for i in range(400)]
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = cotrain.fit(docs, some)
    assert model.prior == 0.5 and cotrain.score(docs, model).count() == 400


def test_odd_rows_and_labels(spark, odd, odd_rows, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = cotrain.score(odd.withColumnRenamed("source", "keep"), cotrain.fit(odd, none))
    assert out.columns == ["doc_id", "text", "lang", "n_chars", "quality_score", "text_score", "meta_score", "keep"]
    assert out.count() == len(odd_rows) and out.where("keep").count() == len(odd_rows)
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(100, 140)] + [(None, 1, 0), (5, None, 0), (100, 0, 1)], "doc_id long, quality int, toxic int")
    out = cotrain.score(odd, cotrain.fit(odd, some))
    assert out.count() == len(odd_rows) and out.where(F.col("quality_score").isNull() | F.isnan("quality_score")).count() == 0
    assert cotrain.score(empty, cotrain.fit(empty, some)).count() == 0


def test_logistic():
    draw = np.random.default_rng(0)
    X = draw.standard_normal((4000, 3))
    p = 1 / (1 + np.exp(-(X @ np.array([1.0, -2.0, 0.5]) + 0.3)))
    y = (draw.random(4000) < p).astype(float)
    assert np.abs(cotrain.Logistic().fit(X, y).probability(X) - p).max() < 0.06
