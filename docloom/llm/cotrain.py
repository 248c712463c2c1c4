"""Quality classifier by co-training: a text-content view and a page-metadata view teach each other.

Every document's text is turned into a short feature row in one pass: shapes of its characters, words and lines, and what its words and pairs of words say: their
mean log odds of good quality, and the mean of the tenth that speak most against it. These odds are counted in hashed buckets on one half of the labelled sample, so that the other half, to which the views are fitted, meets them as new texts do. Two logistic classifiers, one a
view, are fitted on the driver to a bounded sample of labelled documents (``LABELLED``) and a bounded pool
of unlabelled ones (``POOL``). In each round a view labels the pool's documents it is most confident of,
in the proportion of the classes, and they join the other view's training rows. Each view is then
calibrated on labelled rows held out, and a logistic combination of the calibrated views scores all
documents. A document is kept if its combined probability of good quality is at least ``THRESHOLD``.

Defined cases: a document without words is scored by its metadata alone; null metadata are a value of their
own; several labels of one id: the lowest counts; labels of null quality don't count; without labels
of both classes every document scores the share of good labels (1.0 without any) and is kept; rows of a repeated
id are scored one by one, and one of them is learnt from; an empty table gives no rows; extra columns stay, save those named like the
output's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import released, slices, staged, utf8
from docloom.llm.shingles import mixed, word_hashes

LABELLED, POOL, THRESHOLD = 20_000, 20_000, 0.5
#: Buckets of words and pairs of words, what is added to their counts, and labelled texts from which on they are counted.
GRAMS, PRIOR_COUNT, LEAST_LABELLED = 1 << 14, 4.0, 64
ROUNDS, CONFIDENT = 5, 0.97
#: Buckets of the metadata values, by checksum.
LANGS, SOURCES = 8, 32

_CLASS = np.full(256, 0, np.uint8)
_GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,;:'\"()-", "!?", "#$%&*@^~", "|", "{}[]<>=/\\_+")
for _i, _g in enumerate(_GROUPS):
    _CLASS[[ord(c) for c in _g]] = _i + 1
_CLASS[0x80:] = len(_GROUPS) + 1
N_SHAPE = len(_GROUPS) + 2 + 7
N_TEXT = N_SHAPE + 2
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def text_features(t: bytes) -> list[float]:
    if not (words := t.split()):
        return [0.0] * N_SHAPE
    shares = np.sqrt(np.bincount(_CLASS[np.frombuffer(t, np.uint8)], minlength=len(_GROUPS) + 2) / len(t)).tolist()
    n = len(words)
    distinct = len(set(words))
    again = sum(map(eq, words, words[1:])) / n  # noqa: B905
    lines = t.count(b"\n") + 1
    return [*shares, 1.0, np.log1p(n), len(t) / n / 10, distinct / n, np.log(distinct) / np.log(n + 1), np.sqrt(again), np.log1p(len(t) / lines)]


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and pairs of neighbouring words of all texts, and where each text's begin (one more entry than texts): n words, then n - 1 pairs."""
    h, at = word_hashes(texts)
    n = np.diff(at)
    pairs = mixed(h[:-1] * _PAIR + h[1:]) if len(h) else h
    size = n + np.maximum(0, n - 1)
    begins = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(begins[-1]), np.int64)
    for a, b, to in zip(at[:-1].tolist(), at[1:].tolist(), begins[:-1].tolist(), strict=True):
        out[to : to + b - a] = h[a:b] % np.uint64(GRAMS)
        if b - a > 1:
            out[to + b - a : to + 2 * (b - a) - 1] = pairs[a : b - 1] % np.uint64(GRAMS)
    return out, begins


def gram_features(texts: list[bytes], odds: np.ndarray) -> np.ndarray:
    """(texts, 2): the mean log odds of a text's words and pairs, and the mean of the lowest tenth; 0 without words."""
    buckets, begins = grams(texts)
    weight = odds[buckets]
    out = np.zeros((len(texts), 2))
    for i, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
        if b > a:
            k = max(1, (b - a) // 10)
            out[i] = weight[a:b].mean(), np.partition(weight[a:b], k - 1)[:k].mean()
    return out


def metadata_features(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    row = [0.0] * (LANGS + SOURCES + 3)
    row[zlib.crc32((lang or "\0").encode()) % LANGS] = 1.0
    row[LANGS + zlib.crc32((source or "\0").encode()) % SOURCES] = 1.0
    k = np.log1p(max(0, n_chars or 0))
    row[-3:] = [k / 10, (k / 10) ** 2, float(n_chars is None)]
    return row


def views_of(batch: pa.RecordBatch, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of the two views, float32. Columns lang, source and n_chars may be missing."""
    names = batch.schema.names
    lang, source, n_chars = (batch.column(c).to_pylist() if c in names else [None] * batch.num_rows for c in ("lang", "source", "n_chars"))
    texts = list(utf8(batch.column("text")))
    X = np.hstack([np.array([text_features(t) for t in texts]), gram_features(texts, odds)]).astype("<f4")
    M = np.array([metadata_features(*row) for row in zip(lang, source, n_chars, strict=True)], "<f4")
    return X, M


def gram_odds(texts: DataFrame) -> np.ndarray:
    """Log odds of good quality by bucket, from how many good and bad texts (text, _y) have it; counted in each task, GRAMS numbers of each class at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, many = np.zeros((2, GRAMS), np.int64), np.zeros(2, np.int64)
        for batch in slices(batches):
            good = [int(y > 0) for y in batch.column("_y").to_pylist()]
            buckets, begins = grams(list(utf8(batch.column("text"))))
            for y, a, b in zip(good, begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                counts[y, np.unique(buckets[a:b])] += 1
                many[y] += 1
        both = np.hstack([counts, many[:, None]])
        y, bucket = np.nonzero(both)
        yield pa.RecordBatch.from_pydict({"y": pa.array(y, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "n": pa.array(both[y, bucket])})

    counts = np.zeros((2, GRAMS + 1))
    for y, bucket, n in texts.select("_y", "text").mapInArrow(run, "y int, bucket int, n long").groupBy("y", "bucket").agg(F.sum("n")).collect():
        counts[y, bucket] = n
    share = (counts[:, :-1] + PRIOR_COUNT / 2) / (counts[:, -1:] + PRIOR_COUNT)
    return np.log(share[1] / share[0])


def featurized(docs: DataFrame, odds: np.ndarray) -> DataFrame:
    """docs with ``_text`` and ``_meta``: packed float32 features of the two views."""
    docs = docs.drop("_text", "_meta")
    schema = T.StructType([*docs.schema.fields, T.StructField("_text", T.BinaryType()), T.StructField("_meta", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = (pa.array([x.tobytes() for x in view], pa.binary()) for view in views_of(batch, odds))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "_text", "_meta"])

    return docs.mapInArrow(run, schema)


class Logistic:
    """Ridge-penalised logistic regression by Newton's steps, on standardised features; rows may carry weights."""

    def __init__(self, ridge: float = 1.0, steps: int = 25):
        self.ridge, self.steps = ridge, steps

    def fit(self, X: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.scale = X.mean(axis=0), X.std(axis=0) + 1e-6
        Z = np.hstack([(X - self.mean) / self.scale, np.ones((len(X), 1))])
        self.w = np.zeros(Z.shape[1])
        penalty = np.full(Z.shape[1], self.ridge)
        penalty[-1] = 1e-6
        for _ in range(self.steps):
            p = 1 / (1 + np.exp(-np.clip(Z @ self.w, -30, 30)))
            s = p * (1 - p) + 1e-6
            step = np.linalg.solve((Z * s[:, None]).T @ Z + np.diag(penalty), Z.T @ (y - p) - penalty * self.w)
            self.w += step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def logit(self, X: np.ndarray) -> np.ndarray:
        return np.clip(((X - self.mean) / self.scale) @ self.w[:-1] + self.w[-1], -30, 30)

    def probability(self, X: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(X)))


class CoTrained:
    """Both views, their calibration and their combination."""

    def __init__(self, views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pools: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS, confident: float = CONFIDENT):
        self.odds = np.zeros(GRAMS)
        self.prior = float(y.mean()) if len(y) else 1.0
        self.fitted = len(y) >= 8 and len(set(y.tolist())) == 2
        if not self.fitted:
            return
        held = np.arange(len(y)) % 4 == 3
        if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
            held = np.zeros(len(y), bool)
        train = [[v[~held]] for v in views]
        labels = [[y[~held]], [y[~held]]]
        free = np.ones(len(pools[0]), bool)
        self.given = 0
        for _ in range(rounds):
            models = [Logistic().fit(np.vstack(x), np.concatenate(t)) for x, t in zip(train, labels, strict=True)]
            given = 0
            for view, other in ((0, 1), (1, 0)):
                at = np.flatnonzero(free)
                if not len(at):
                    break
                p = models[view].probability(pools[view][at])
                most = max(2, len(y) // (4 * rounds))
                good = at[(p >= confident)][np.argsort(-p[p >= confident], kind="stable")][: max(1, round(most * self.prior))]
                bad = at[(p <= 1 - confident)][np.argsort(p[p <= 1 - confident], kind="stable")][: max(1, round(most * (1 - self.prior)))]
                # both classes together, in their proportion, or the other view's prior would drift
                if not len(good) or not len(bad):
                    continue
                chosen = np.concatenate([good[: max(1, round(len(bad) * self.prior / max(1e-6, 1 - self.prior)))], bad])
                train[other].append(pools[other][chosen])
                labels[other].append(pools_label := np.concatenate([np.ones(len(chosen) - len(bad)), np.zeros(len(bad))]))
                free[chosen] = False
                given += len(pools_label)
            self.given += given
            if not given:
                break
        self.models = [Logistic().fit(np.vstack(x), np.concatenate(t)) for x, t in zip(train, labels, strict=True)]
        rows = held if held.any() else np.ones(len(y), bool)
        logits = [m.logit(v[rows])[:, None] for m, v in zip(self.models, views, strict=True)]
        self.calibration = [Logistic(ridge=0.1).fit(z, y[rows]) for z in logits]
        both = np.hstack([c.logit(z)[:, None] for c, z in zip(self.calibration, logits, strict=True)])
        self.combined = Logistic(ridge=0.1).fit(both, y[rows])

    def score(self, X: np.ndarray, M: np.ndarray) -> np.ndarray:
        """(rows, 3): probability of good quality combined, by text, by metadata."""
        if not self.fitted:
            return np.full((len(X), 3), self.prior)
        z = [c.logit(m.logit(v)[:, None])[:, None] for c, m, v in zip(self.calibration, self.models, (X, M), strict=True)]
        views = [1 / (1 + np.exp(-v[:, 0])) for v in z]
        both = self.combined.probability(np.hstack(z))
        wordless = X[:, len(_GROUPS) + 2] == 0
        return np.stack([np.where(wordless, views[1], both), views[0], views[1]], axis=1)


def _packed(rows: list, column: str, width: int) -> np.ndarray:
    return np.stack([np.frombuffer(r[column], "<f4") for r in rows]).astype(float) if rows else np.zeros((0, width))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", labelled: int = LABELLED, pool: int = POOL) -> CoTrained:
    """Fit on at most ``labelled`` labelled and ``pool`` unlabelled documents, drawn by the hash of the id."""
    first = F.xxhash64("_id", F.lit(29))
    given = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_y"))
    wanted = [c for c in ("text", "lang", "source", "n_chars") if c in docs.columns]
    named = docs.select(F.col(id_col).alias("_id"), *wanted)
    ids = named.select("_id").where("_id IS NOT NULL").distinct()
    chosen = ids.join(given, "_id").orderBy(first, "_id").limit(labelled)
    others = ids.join(given, "_id", "left_anti").orderBy(first, "_id").limit(pool).withColumn("_y", F.lit(None).cast(given.schema["_y"].dataType))
    sample = chosen.unionByName(others)
    # labelled + pool rows at most: of several rows of an id the least features count
    drawn = staged(named.join(F.broadcast(sample), "_id"), "sample")
    counting = F.pmod(F.xxhash64("_id", F.lit(37)), F.lit(2)) == 0
    odds = np.zeros(GRAMS)
    if chosen.count() >= LEAST_LABELLED:
        odds = gram_odds(drawn.where(F.col("_y").isNotNull() & counting))
        drawn = drawn.where(F.col("_y").isNull() | ~counting)
    rows = featurized(drawn, odds).groupBy("_id", "_y").agg(F.min(F.struct("_text", "_meta")).alias("_x")).select("_id", "_y", "_x.*").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["_id"]).encode()), r["_id"]))
    known, unknown = [r for r in rows if r["_y"] is not None], [r for r in rows if r["_y"] is None]
    width = LANGS + SOURCES + 3
    views, y, pools = (_packed(known, "_text", N_TEXT), _packed(known, "_meta", width)), np.array([float(r["_y"] > 0) for r in known]), (_packed(unknown, "_text", N_TEXT), _packed(unknown, "_meta", width))
    del rows, known, unknown
    model = CoTrained(views, y, pools)
    model.odds = odds
    del views, pools
    released()  # the driver goes on to other work
    return model


def score(docs: DataFrame, model: CoTrained, threshold: float = THRESHOLD) -> DataFrame:
    """docs with quality_score, text_score, meta_score and keep, in one pass over the texts."""
    docs = docs.drop("quality_score", "text_score", "meta_score", "keep")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scores = ("quality_score", "text_score", "meta_score")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in scores)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            X, M = views_of(batch, own.odds)
            made = own.score(X.astype(float), M.astype(float))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(made[:, i]) for i in range(3))], [*batch.schema.names, *scores])

    scored = docs.mapInArrow(run, schema)
    return scored.withColumn("keep", (F.col("quality_score") >= threshold) | F.lit(not model.fitted))
