"""Toxicity of texts by a convolutional network: hashed word embeddings, filters of several widths, max pooling.

A word is a run of letters, digits and bytes from 0x80, A-Z lower-cased. Its vector is the sum of three hashed embeddings: of the word, and of
its first four and five bytes, so that unseen forms of a known stem are known. Filters of one, two and three words pass over
the whole text; each filter's highest answer, rectified, feeds a logistic output. The network is trained by stochastic
steps in numpy on all labelled documents: they are dealt by the hash of the id to parts of about ``PART`` documents or
``WORDS`` words, each part trains a copy, and after each half of the epochs the copies are averaged, an embedding over those that
met it. Documents of no more than one part are learnt from on the driver, one copy over all epochs. A quarter of the documents is left out of training and sets the thresholds, by counts of all its
answers in steps of 1/``GRAIN``: one for each language of which it holds ``FEW`` toxic and ``FEW`` clean texts, else the one of all. The language is guessed from the
function words of the text itself. A score is a logistic function of the network's output less the threshold, so 0.5 is the threshold of each language.

Defined cases: a null text counts as an empty one, which is scored like any other; labels of null count for nothing; of
several labels of an id the highest counts, and one of its rows is learnt from; without labels of both classes every
document scores their mean (0 without any); rows of a repeated id are scored one by one; an empty table gives no rows; extra columns stay,
save those named like the output's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from docloom.llm.common import collected, released, set_aside, slices, staged, utf8
from docloom.llm.shingles import mixed, powers

PART, WORDS = 7500, 8_000_000
#: Steps of an answer counted apart, and the answer beyond which it counts as this one; cells that weights are averaged in.
GRAIN, FAR, CELLS = 256, 64, 16
#: How often the copies are averaged, and bits of the set by which documents without a label stay out of the shuffle.
ROUNDS, ID_BITS = 2, 1 << 25
BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 16, 16, (1, 2, 3), 8
EPOCHS, BATCH, FEW = 6, 32, 20
PREFIXES = (4, 5)
#: Places of the text worked on at once.
PLACES = 1 << 16

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with was are this by at it on as from be have not which their",
    "de": "der die das und ist von mit nicht den für ein eine zu dem auf sich des auch wie wird bei sind",
    "fr": "le la les des est et une pour dans que qui du sur pas au avec ce par plus sont mais nous",
    "es": "el los las una y en por con para del se lo su al como más pero sus este está son",
}

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 256)]] = True


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words, 3) uint16 buckets of all words of the texts in order, none of them 0, and where each text's words begin (one more entry than texts)."""
    joined = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if not len(joined):
        return np.zeros((0, 1 + len(PREFIXES)), np.uint16), np.zeros(len(texts) + 1, np.int64)
    within = _WORD[joined]
    edge = np.diff(within.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(joined) + 1)
    total = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((_FOLD[joined].astype(np.uint64) + np.uint64(1)) * up[: len(joined)], out=total[1:])
    out = np.empty((len(start), 1 + len(PREFIXES)), np.uint16)
    for i, size in enumerate((None, *PREFIXES)):
        stop = end if size is None else np.minimum(end, start + size)
        h = mixed((total[stop] - total[start]) * down[start] + np.uint64(i * 0x9E3779B1))
        out[:, i] = 1 + h % np.uint64(BUCKETS - 1)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return out, np.searchsorted(start, offsets)


def language_table() -> np.ndarray:
    """The language of each bucket that holds a function word, from 1; else 0."""
    table = np.zeros(BUCKETS, np.uint8)
    for n, words in enumerate(FUNCTION_WORDS.values(), 1):
        ids, _ = word_ids([words.encode()])
        table[ids[:, 0]] = n
    return table


def languages(ids: np.ndarray, begins: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The language that most function words of each text belong to, from 1; 0 if it has none."""
    of = table[ids[:, 0]]
    counts = np.stack([np.concatenate([[0], np.cumsum(of == n)])[begins] for n in range(1, len(FUNCTION_WORDS) + 1)])
    counts = np.diff(counts, axis=1)
    return np.where(counts.max(axis=0) > 0, counts.argmax(axis=0) + 1, 0)


def framed(ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words with blanks behind each text (a blank word in an empty one), and the first and last-but-one place of each text where a filter may begin."""
    n, blanks = np.diff(begins), WIDTHS[-1] - 1
    sizes = np.maximum(1, n)
    first = np.concatenate([[0], np.cumsum(sizes + blanks)[:-1]]) if len(n) else np.zeros(0, np.int64)
    out = np.zeros((int((sizes + blanks).sum()), ids.shape[1]), np.uint16)
    out[np.repeat(first - begins[:-1], n) + np.arange(len(ids))] = ids
    return out, first, first + sizes


class Network:
    """Embeddings, filters and output; learns by single steps over batches of texts."""

    def __init__(self, seed: int = 5):
        draw = np.random.default_rng(seed)
        self.emb = draw.normal(0, 0.05, (BUCKETS, SIZE)).astype(np.float32)
        self.emb[0] = 0
        self.filters = [draw.normal(0, 0.5 / np.sqrt(w), (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        self.bias, self.out, self.shift = np.zeros(n, np.float32), draw.normal(0.5, 0.1, n).astype(np.float32), np.float32(-1)
        self.seen_emb = np.full(BUCKETS, 1e-6, np.float32)
        self.seen = [np.full_like(x, 1e-6) for x in (*self.filters, self.bias, self.out)]
        self.seen_shift = 1e-6

    def dense(self) -> np.ndarray:
        """(2, n): what is not an embedding, and what it has seen."""
        seen = [*self.seen, np.array([self.seen_shift])]
        return np.stack([np.concatenate([np.ravel(x) for x in xs]) for xs in ([*self.filters, self.bias, self.out, self.shift], seen)]).astype(np.float32)

    def load(self, emb: np.ndarray, seen_emb: np.ndarray, dense: np.ndarray) -> Network:
        self.emb, self.seen_emb = emb.copy(), seen_emb.copy()
        at = 0
        for x, seen in zip((*self.filters, self.bias, self.out), self.seen, strict=True):
            x[...], seen[...] = (dense[i, at : at + x.size].reshape(x.shape) for i in (0, 1))
            at += x.size
        self.shift, self.seen_shift = np.float32(dense[0, at]), float(dense[1, at])
        return self

    def learn(self, ids: list[np.ndarray], y: np.ndarray, balance: np.ndarray, epochs: range, draw: np.random.Generator) -> None:
        for epoch in epochs:
            for part in np.array_split(draw.permutation(len(ids)), max(1, len(ids) // BATCH)):
                self.step(*joined([ids[i] for i in part]), y[part], balance[part], 0.1 / (1 + epoch))

    def answers(self, X: np.ndarray) -> np.ndarray:
        """(places, filters): what each filter says at each place, given the vectors of the places and the blanks after them."""
        places = len(X) - (WIDTHS[-1] - 1)
        out = np.empty((places, FILTERS * len(WIDTHS)), np.float32)
        for i, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            part = X[:places] @ f[0]
            for j in range(1, w):
                part += X[j : j + places] @ f[j]
            out[:, i * FILTERS : (i + 1) * FILTERS] = part
        return out

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        X = self.emb[ids[:, 0]]
        for i in range(1, ids.shape[1]):
            X += self.emb[ids[:, i]]
        return X

    def pooled(self, ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """(texts, filters): the highest answer of each filter in each text, over slices of the places."""
        out = np.full((len(first), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        blanks = WIDTHS[-1] - 1
        for a in range(0, len(ids) - blanks, PLACES):
            b = min(a + PLACES, len(ids) - blanks)
            texts = np.flatnonzero((first < b) & (last > a))
            if not len(texts):
                continue
            H = self.answers(self.vectors(ids[a : b + blanks]))
            edges = np.stack([np.maximum(first[texts], a), np.minimum(last[texts], b)], axis=1).ravel() - a
            # reduceat takes the stretch between two edges; every other one is a text's
            edges = edges[:-1] if edges[-1] >= len(H) else edges
            out[texts] = np.maximum(out[texts], np.maximum.reduceat(H, edges, axis=0)[::2])
        return out

    def logits(self, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return np.maximum(0, self.pooled(*framed(ids, begins)) + self.bias) @ self.out + self.shift

    def step(self, ids: np.ndarray, begins: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One step of the gradient, scaled by what each parameter has seen."""
        places, first, last = framed(ids, begins)
        X = self.vectors(places)
        H = self.answers(X)
        at = np.stack([H[a:b].argmax(axis=0) + a for a, b in zip(first.tolist(), last.tolist(), strict=True)])
        z = np.take_along_axis(H, at, 0) + self.bias
        h = np.maximum(0, z)
        p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.shift, -30, 30)))
        d = (weight * (p - y) / len(y)).astype(np.float32)
        d_out, d_shift = d @ h, float(d.sum())
        dz = d[:, None] * self.out * (z > 0)
        grads, rows, deltas = [], [], []
        for i, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            own, where = dz[:, i * FILTERS : (i + 1) * FILTERS], at[:, i * FILTERS : (i + 1) * FILTERS]
            grad = np.empty_like(f)
            for j in range(w):
                grad[j] = np.einsum("tfs,tf->sf", X[where + j], own)
                rows.append(places[where + j].reshape(-1, places.shape[1]))
                deltas.append((own[:, :, None] * f[j].T).reshape(-1, SIZE))
            grads.append(grad)
        touched, at_row = np.unique(np.concatenate(rows), return_inverse=True)
        d_emb = np.zeros((len(touched), SIZE), np.float32)
        np.add.at(d_emb, at_row.reshape(-1), np.repeat(np.concatenate(deltas), places.shape[1], axis=0))
        d_emb[touched == 0] = 0
        self.seen_emb[touched] += (d_emb * d_emb).mean(axis=1)
        self.emb[touched] -= rate * d_emb / np.sqrt(self.seen_emb[touched])[:, None]
        for x, g, seen in zip((*self.filters, self.bias, self.out), (*grads, dz.sum(axis=0), d_out), self.seen, strict=True):
            seen += g * g
            x -= rate * g / np.sqrt(seen)
        self.seen_shift += d_shift * d_shift
        self.shift -= np.float32(rate * d_shift / np.sqrt(self.seen_shift))


def joined(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])


def unpacked(words: bytes) -> np.ndarray:
    return np.frombuffer(words, np.uint16).reshape(-1, 1 + len(PREFIXES))


def threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut of z with the least weighted errors; of equal ones the one in the widest gap."""
    order = np.argsort(z, kind="stable")
    z, y, weight = z[order], y[order], weight[order]
    missed = np.concatenate([[0], np.cumsum(weight * y)])  # toxic below the cut
    false = np.concatenate([[0], np.cumsum(weight * (1 - y))])
    wrong = missed + false[-1] - false
    edges = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    gap = np.diff(edges)
    wrong = np.where(gap > 0, wrong, np.inf)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    k = best[gap[best].argmax()]
    return float((edges[k] + edges[k + 1]) / 2)


def class_weights(there: tuple[int, int], totals: tuple[int, int]) -> np.ndarray:
    """What a clean and a toxic document stand for where not all are there, with a mean of 1 over those there."""
    share = np.array([t / max(1, n) for n, t in zip(there, totals, strict=True)])
    return share * sum(there) / max(1e-9, float(share @ np.array(there, float)))


class Toxicity:
    """A trained network with the thresholds of the languages. texts: (packed word buckets, label) in the order of learning; without them ``network`` and ``settle`` are given later."""

    def __init__(self, texts: list[tuple[bytes, int]], totals: tuple[int, int], epochs: int = EPOCHS):
        y = np.array([t[1] for t in texts], float)
        self.prior = totals[1] / max(1, sum(totals))
        self.fitted = len(set(y.tolist())) == 2
        if not self.fitted:
            return
        ids = [unpacked(t[0]) for t in texts]
        share = class_weights((int((1 - y).sum()), int(y.sum())), totals)
        weight = share[y.astype(int)]
        held = np.arange(len(y)) % 4 == 3
        if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
            held = np.zeros(len(y), bool)
        self.network = Network()
        train = np.flatnonzero(~held)
        self.network.learn([ids[i] for i in train], y[train], np.sqrt(weight[train]), range(epochs), np.random.default_rng(11))
        table, rows = language_table(), np.flatnonzero(held) if held.any() else np.arange(len(y))
        z, lang = [], []
        for part in np.array_split(rows, max(1, len(rows) // 256)):
            its = joined([ids[i] for i in part])
            z.append(self.network.logits(*its))
            lang.append(languages(*its, table))
        self.settle(np.concatenate(z).astype(float), np.concatenate(lang), y[rows], np.ones(len(rows)), weight[rows])

    def settle(self, z: np.ndarray, lang: np.ndarray, y: np.ndarray, n: np.ndarray, weight: np.ndarray) -> None:
        """Thresholds and steepness from answers of documents left out of training, each standing for n of them of the given weight."""
        self.fitted, self.table = True, language_table()
        weight = weight * n
        every = threshold(z, y, weight)
        self.cuts = np.full(len(FUNCTION_WORDS) + 1, every)
        for k in range(len(self.cuts)):
            own = lang == k
            if min(n[own & (y == 1)].sum(), n[own & (y == 0)].sum()) >= FEW:
                self.cuts[k] = threshold(z[own], y[own], weight[own])
        # the steepness with the least weighted log loss about the thresholds
        away = z - self.cuts[lang]
        grid = np.geomspace(0.1, 10, 41)
        loss = [float((weight * np.logaddexp(0, np.where(y == 1, -1, 1) * s * away)).sum()) for s in grid]
        self.slope = float(grid[int(np.argmin(loss))])

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), self.prior)
        ids, begins = word_ids(texts)
        z = self.network.logits(ids, begins).astype(float) - self.cuts[languages(ids, begins, self.table)]
        return 1 / (1 + np.exp(-np.clip(self.slope * z, -30, 30)))


def with_words(docs: DataFrame) -> DataFrame:
    """(id, words): packed word buckets of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, begins = word_ids(list(utf8(batch.column("text"))))
            words = pa.array([ids[a:b].tobytes() for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), words], ["id", "words"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, words binary")


def _epochs(rows: DataFrame, net: Network, parts: int, balance: np.ndarray, epochs: range) -> Network:
    """The rows (part, id, y, words) of each part train a copy of the network over some epochs; an embedding is the mean of the copies that met it, the rest the mean of all by their documents."""
    shared = rows.sparkSession.sparkContext.broadcast((net.emb, net.seen_emb, net.dense(), balance))
    size = BUCKETS // CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int]] = []
        now = None
        for batch in batches:
            for part, y, words in zip(batch.column("part").to_pylist(), batch.column("y").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if part != now and held:  # the rows of a part follow each other, and a task may have several
                    yield trained(now, held)
                    held = []
                now = part
                held.append((unpacked(words), y))
        if held:
            yield trained(now, held)
        released()

    def trained(part: int, held: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
        emb, seen_emb, dense, share = shared.value
        own, y = Network().load(emb, seen_emb, dense), np.array([y for _, y in held], float)
        own.learn([x for x, _ in held], y, share[y.astype(int)], epochs, np.random.default_rng([11, part, epochs.start]))
        met = (own.seen_emb != seen_emb).astype(np.float32)
        table = np.concatenate([own.emb, own.seen_emb[:, None], np.ones((BUCKETS, 1), np.float32)], axis=1) * met[:, None]
        cells = [table[i * size : (i + 1) * size].astype("<f4").tobytes() for i in range(CELLS)] + [(own.dense() * len(held)).astype("<f4").tobytes()]
        n = len(cells)
        return pa.RecordBatch.from_pydict({"part": pa.array([part] * n, pa.int64()), "cell": pa.array(range(n), pa.int32()), "n": pa.array([len(held)] * n, pa.int64()), "sums": pa.array(cells, pa.binary())})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for cell, n, sums in zip(batch.column("cell").to_pylist(), batch.column("n").to_pylist(), batch.column("sums"), strict=True):
                m, total = held.get(cell, (0, 0.0))
                held[cell] = m + n, total + np.frombuffer(sums.as_buffer(), "<f4").astype(float)
        for cell, (n, total) in held.items():
            yield pa.RecordBatch.from_pydict({"cell": pa.array([cell], pa.int32()), "n": pa.array([n], pa.int64()), "sums": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    dealt = rows.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", F.xxhash64("id", F.lit(37)), "id")
    copies = dealt.select("part", "y", "words").mapInArrow(run, "part long, cell int, n long, sums binary")
    got = collected(copies.repartitionById(CELLS + 1, "cell").sortWithinPartitions("cell", "part").select("cell", "n", "sums").mapInArrow(summed, "cell int, n long, sums binary"))  # one network
    *cells, last = sorted(got, key=lambda r: r["cell"])
    table = np.concatenate([np.frombuffer(r["sums"], "<f4") for r in cells]).reshape(BUCKETS, SIZE + 2)
    met = table[:, -1:] > 0
    mean = table[:, :-1] / np.maximum(1, table[:, -1:])
    dense = np.frombuffer(last["sums"], "<f4").reshape(2, -1) / last["n"]
    return Network().load(np.where(met, mean[:, :SIZE], net.emb), np.where(met[:, 0], mean[:, SIZE], net.seen_emb), dense)


def _answers(rows: DataFrame, net: Network) -> DataFrame:
    """(lang, y, at, n): how many of the rows (y, words) have an answer in each step of 1/GRAIN."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = shared.value, language_table()
        for batch in slices(batches, "words"):
            its = joined([unpacked(w) for w in batch.column("words").to_pylist()])
            at = np.floor(np.clip(own.logits(*its).astype(float), -FAR, FAR) * GRAIN).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(languages(*its, table).astype(np.int32)), batch.column("y"), pa.array(at)], ["lang", "y", "at"])

    return rows.select("y", "words").mapInArrow(run, "lang int, y int, at int").groupBy("lang", "y", "at").agg(F.count(F.lit(1)).alias("n"))


def _maybe_in(named: DataFrame, given: DataFrame) -> DataFrame:
    """The rows of named whose id may be in given, by bits of its hash; ID_BITS of them at most are sent about."""
    bit = F.pmod(F.xxhash64("id", F.lit(71)), F.lit(ID_BITS))
    sets = given.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_bits"))
    at = named.withColumn("_bit", bit).withColumns({"_bucket": F.bitmap_bucket_number("_bit"), "_at": F.bitmap_bit_position("_bit")})
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return at.join(F.broadcast(sets), "_bucket").where(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1).select(*named.columns)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", toxic: int | None = None, clean: int | None = None, words: int | None = None) -> Toxicity:
    """Fit on all labelled documents of labels (doc_id, toxic), or if asked on so many toxic and clean ones, of so many words together."""
    first = F.xxhash64("id", F.lit(31))
    given = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    totals = {r["y"]: r["n"] for r in given.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = (totals.get(0, 0), totals.get(1, 0))
    named = docs.select(F.col(id_col).alias("id"), "text")
    if toxic is not None or clean is not None:
        there = given.join(named.select("id"), "id", "left_semi")
        some = lambda y, n: there.where(f"y = {y}") if n is None else there.where(f"y = {y}").orderBy(first, "id").limit(n)
        given = some(1, toxic).unionByName(some(0, clean))
    # of the rows of an id one is learnt from; words are made ahead of the join, so that the grouping needs no shuffle of its own
    rows = staged(with_words(_maybe_in(named, given)).join(given, "id").groupBy("id", "y").agg(F.min("words").alias("words")), "toxic")
    if words is not None:
        sizes = rows.select("id", F.length("words").alias("n")).withColumn("all", F.sum("n").over(W.orderBy(first, "id")))
        rows = rows.join(sizes.where(F.col("all") <= words * 2 * (1 + len(PREFIXES))).select("id"), "id")
    left_out = F.pmod(F.xxhash64("id", F.lit(57)), F.lit(4)) == 3
    counts = {(r["y"], r["out"]): (r["n"], r["size"]) for r in rows.groupBy("y", left_out.alias("out")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("words")).alias("size")).collect()}
    if sum(n for n, _ in counts.values()) <= PART * 3 // 2 and sum(size for _, size in counts.values()) <= WORDS * 2 * (1 + len(PREFIXES)):
        got = sorted(rows.collect(), key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"]))
        model = Toxicity([(bytes(r["words"]), r["y"]) for r in got], totals)
        del got
        released()  # the driver goes on to other work
        return model
    model = Toxicity([], totals)
    if {y for y, _ in counts} != {0, 1}:
        return model
    there = tuple(sum(n for (k, _), (n, _) in counts.items() if k == y) for y in (0, 1))
    apart = len(counts) == 4  # both classes on both sides
    train, rest = (rows.where(~left_out), rows.where(left_out)) if apart else (rows, rows)
    mine = [v for (_, out), v in counts.items() if not (apart and out)]
    n, size = sum(x for x, _ in mine), sum(x for _, x in mine)
    parts = max(1, round(n / PART), -(-size // (WORDS * 2 * (1 + len(PREFIXES)))))
    dealt = train.withColumn("part", F.pmod(F.xxhash64("id", F.lit(43)), F.lit(parts)))
    share = class_weights(there, totals)
    model.network = Network()
    for epochs in (range(e, e + EPOCHS // ROUNDS) for e in range(0, EPOCHS, EPOCHS // ROUNDS)):
        model.network = _epochs(dealt, model.network, parts, np.sqrt(share), epochs)
    got = _answers(rest, model.network).orderBy("lang", "y", "at").collect()  # steps of an answer, however many documents
    lang, y, at, many = (np.array([r[c] for r in got]) for c in ("lang", "y", "at", "n"))
    model.settle((at + 0.5) / GRAIN, lang, y.astype(float), many, share[y])
    released()  # the driver goes on to other work
    return model


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """docs with ``score`` and ``predicted``, in one pass over the texts."""
    docs, restored = set_aside(docs.drop("score", "predicted"), "id", "y", "words")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.score(list(utf8(batch.column("text")))))], [*batch.schema.names, "score"])

    return restored(docs.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
