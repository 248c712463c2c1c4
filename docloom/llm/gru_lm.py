"""Language-model scoring: a gated recurrent network in numpy with a class-factored softmax.

1. Words of all training documents are counted (sums made in the tasks, then by word). Counts, their
   sum and the number of distinct tokens cover every training token; the unigram base comes from them.
2. The ``KNOWN`` most frequent tokens are the network's own; classes of about equal mass cut them in order of
   frequency, and one more class holds all other tokens, which follow their unigram within it. So
   P(token) = P(class | state) * P(token | class, state), a distribution over all tokens and one unknown.
3. The network starts as the unigram and is trained by truncated backpropagation: in each round the round's
   training documents are dealt by key to parts of about PART_TOKENS tokens, each trains a copy of the
   network on streams of documents with the state carried from window to window, and the weights are averaged by
   tokens. Each training document is learnt from once; a larger ``share`` takes one document in so many. The
   result depends on the rows, not on their layout.
4. Every document is scored whole: documents run in lanes, a window of steps at a time, the
   state carried across windows and reset at a document's start.

Tokens beyond the ``HEAD`` most frequent aren't held in the tasks: their counts are joined by word.

Defined cases: a null text is an empty one and has the end token alone; a null id counts as '' in the
training split; without training tokens N is 0 and the base is uniform over one token; repeated ids are
separate rows; extra columns are not returned.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import collected, row_keyed, slices, staged, utf8

HEAD, KNOWN, CLASSES, HIDDEN = 1 << 17, 2048, 48, 16
#: One document in SHARE is trained on, dealt over ROUNDS rounds.
SHARE, ROUNDS = 1, 2
#: Lanes of a training step at most, fewer where a part has not STEPS steps of these; steps of a window; Adam's rate at first.
LANES, WINDOW, RATE, STEPS = 256, 16, 0.03, 200
#: Training tokens of one task's copy of the network in a round, about.
PART_TOKENS = 1 << 21
#: Steps of a scoring window, and lanes.
SCORE_WINDOW, SCORE_LANES = 32, 512
FLUSH = 400_000
LN10 = math.log(10)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over (text); '' stands for the end of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()).cast(pa.string()), "c": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return out

        for batch in batches:
            for t in utf8(batch.column("text")):
                counts.update(t.lower().split())
                counts[b""] += 1
                if len(counts) >= FLUSH:
                    yield flushed()
        if counts:
            yield flushed()

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Places(dict):
    """Place by word; ``none`` for any other."""

    def __init__(self, none: int, places: dict[bytes, int]):
        super().__init__(places)
        self.none = none

    def __missing__(self, word: bytes) -> int:
        return self.none

    def __reduce__(self):
        return Places, (self.none, dict(self))


class Words:
    """The head of the vocabulary: place by word, counts, the network's classes. Place 0 is the end token; tokens from ``known`` on are in the last class."""

    def __init__(self, words: list[str], counts: list[int], total: int, distinct: int, known: int, classes: int):
        self.place = Places(len(words), {w.encode(): i for i, w in enumerate(words)})
        self.counts = np.array(counts, float)
        self.total, self.distinct = total, distinct
        self.known = min(known, len(words))
        self.own = Places(self.known, {w.encode(): i for i, w in enumerate(words[: self.known])})
        c = self.counts[: self.known] + 0.5
        mass = np.cumsum(c) / c.sum() if len(c) else c
        cut = np.minimum((mass * classes - 1e-9).astype(int), classes - 1) if len(c) else np.zeros(0, int)
        cut = np.unique(cut, return_inverse=True)[1] if len(c) else cut
        self.classes = int(cut.max()) + 1 if len(c) else 0
        self.of = np.append(cut, self.classes)  # class of each known token, then of the rest
        self.starts = np.searchsorted(cut, np.arange(self.classes + 1))
        self.rest = total + 0.5 * (distinct + 1) - c.sum()  # smoothed mass of all other tokens and the unknown one
        in_class = np.array([c[a:b].sum() for a, b in zip(self.starts[:-1], self.starts[1:], strict=True)])
        self.class_bias = np.log(np.append(in_class, max(self.rest, 1e-9)))
        self.word_bias = np.log(c)
        self.log_count = np.log10(self.counts + 0.5)

    def own_ids(self, text: bytes) -> np.ndarray:
        """Places of a text's tokens, the end last, ``known`` for all but the network's own."""
        words = text.lower().split()
        words.append(b"")
        return np.fromiter(map(self.own.__getitem__, words), np.int32, len(words))

    def ids(self, text: bytes) -> tuple[np.ndarray, list[bytes]]:
        """Places of a text's tokens, the end last, len(place) for those beyond the head, and these."""
        words = text.lower().split()
        words.append(b"")
        got = np.fromiter(map(self.place.__getitem__, words), np.int32, len(words))
        return got, [words[i] for i in np.flatnonzero(got[:-1] == len(self.place)).tolist()]


class Network:
    """A gated recurrent unit over known tokens (place ``known``: any other), class logits and word logits."""

    NAMES = ("E", "U", "B", "Wc", "bc", "Wo", "bo")

    def __init__(self, words: Words, hidden: int = HIDDEN, seed: int = 3):
        self.words, self.hidden = words, hidden
        draw = np.random.default_rng(seed)
        k, c = words.known, words.classes + 1
        self.shapes = {"E": (k + 1, 3 * hidden), "U": (hidden, 3 * hidden), "B": (3 * hidden,), "Wc": (hidden, c), "bc": (c,), "Wo": (k, hidden), "bo": (k,)}
        p = {n: np.zeros(s, np.float32) for n, s in self.shapes.items()}
        p["E"] = (0.3 * draw.standard_normal(self.shapes["E"])).astype(np.float32)
        p["U"] = (draw.standard_normal(self.shapes["U"]) / math.sqrt(hidden)).astype(np.float32)
        p["bc"], p["bo"] = words.class_bias.astype(np.float32), words.word_bias.astype(np.float32)
        self.p = p

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for n in self.NAMES:
            size = int(np.prod(self.shapes[n]))
            self.p[n] = flat[at : at + size].reshape(self.shapes[n]).astype(np.float32)
            at += size
        return self

    def forward(self, h: np.ndarray, X: np.ndarray, reset: np.ndarray, keep: bool = False):
        """States (steps, lanes, hidden) for inputs X; lanes are reset where told. With ``keep`` what backpropagation needs."""
        out, h, kept = self.states(h, X, reset, keep)
        return out.transpose(1, 2, 0), h, kept

    def states(self, h: np.ndarray, X: np.ndarray, reset: np.ndarray, keep: bool = False):
        """As forward(), the states as (hidden, steps, lanes): lanes run along the last axis, so each gate is rows of memory."""
        H, (steps, lanes) = self.hidden, X.shape
        U = np.ascontiguousarray(self.p["U"].T)
        E = np.ascontiguousarray((self.p["E"] + self.p["B"]).T)
        out = np.empty((H, steps, lanes), np.float32)
        kept = []
        any_reset = reset.any(axis=1)
        h, half = np.ascontiguousarray(h.T), np.float32(0.5)
        for t in range(steps):
            if any_reset[t]:
                h = h * ~reset[t]
            g = U @ h
            G = np.take(E, X[t], axis=1, mode="clip")
            zr, n = G[: 2 * H], G[2 * H :]
            zr += g[: 2 * H]
            zr *= half
            np.tanh(zr, out=zr)
            zr *= half
            zr += half
            n += zr[H:] * g[2 * H :]
            np.tanh(n, out=n)
            if keep:
                kept.append((h, g[2 * H :], zr, n))
            h = h - n
            h *= zr[:H]
            h += n
            out[:, t] = h
        return out, h.T, kept

    def output(self, S: np.ndarray, Y: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the targets Y (class and place within; tokens of the last class: of the class alone) given states S (rows, hidden)."""
        return self.answers(S.T, Y)

    def answers(self, S: np.ndarray, Y: np.ndarray, gradient: bool = False):
        """As output(), given states (hidden, rows); optionally gradients of their sum, in terms of -sum. Rows are worked on in order of their class, each class as one slice."""
        words, p, H = self.words, self.p, self.hidden
        cls = words.of[Y]
        order = np.argsort(cls.astype(np.uint16), kind="stable")  # of few bits: no comparisons
        cls, own = cls[order], Y[order]
        kind = np.result_type(S, p["Wo"])
        s = np.ones((H + 1, len(Y)), kind)  # a column a row; ones stand for the bias
        s[:H] = S[:, order]
        rows = np.arange(len(Y))
        grads: dict[str, np.ndarray] = {}
        logp, dS = np.zeros(len(Y), kind), np.zeros((H, len(Y)), kind)

        def softmax(W: np.ndarray, lo: int, hi: int, its: np.ndarray, far: bool) -> np.ndarray | None:
            """Adds log P of its to logp; with gradients their part to dS, and returns that of W. The sum of a row is divided by at the narrow side of each product."""
            part, r = s[:, lo:hi], rows[: hi - lo]
            x = W @ part
            if far:  # beyond what exp holds
                x -= x.max(axis=0)
            hit = x[its, r]
            np.exp(x, out=x)
            total = ones[: len(x)] @ x
            logp[lo:hi] += hit - np.log(total)
            if not gradient:
                return None
            x[its, r] -= total
            total = 1 / total
            dS[:, lo:hi] += (W[:, :H].T @ x) * total
            return x @ (part * total).T

        weights = [np.concatenate([p["Wc"].T, p["bc"][:, None]], axis=1), np.concatenate([p["Wo"], p["bo"][:, None]], axis=1)]
        reach = [float(np.abs(w).sum(axis=1).max(initial=0)) > 60 for w in weights]  # states are within -1 and 1
        ones = np.ones(max(map(len, weights)), kind)
        got = softmax(weights[0], 0, len(Y), cls, reach[0])
        if gradient:
            grads["Wc"], grads["bc"] = np.ascontiguousarray(got[:, :H].T), np.ascontiguousarray(got[:, H])
            of_words = np.zeros_like(weights[1])
        bounds = np.searchsorted(cls, np.arange(words.classes + 1)).tolist()
        starts = words.starts.tolist()
        for c in range(words.classes):
            a, b, lo, hi = starts[c], starts[c + 1], bounds[c], bounds[c + 1]
            if b - a < 2 or lo == hi:
                continue
            got = softmax(weights[1][a:b], lo, hi, own[lo:hi] - a, reach[1])
            if gradient:
                of_words[a:b] = got
        back = np.empty_like(logp)
        back[order] = logp
        if not gradient:
            return back
        grads["Wo"], grads["bo"] = np.ascontiguousarray(of_words[:, :H]), np.ascontiguousarray(of_words[:, H])
        unsorted = np.empty_like(dS)
        unsorted[:, order] = dS
        return back, unsorted, grads

    def gradients(self, h: np.ndarray, X: np.ndarray, Y: np.ndarray, reset: np.ndarray):
        """Gradients of the mean loss of one window, backpropagated to its first step; the state after it."""
        H, (steps, lanes) = self.hidden, X.shape
        S, last, kept = self.states(h, X, reset, keep=True)
        logp, dS, grads = self.answers(S.reshape(H, -1), Y.ravel(), gradient=True)
        full = dS.reshape(H, steps, lanes)
        U = np.ascontiguousarray(self.p["U"])
        dG = np.empty((3 * H, steps, lanes), np.float32)
        dU = np.zeros((3 * H, H), np.float32)
        dh, one = np.zeros((H, lanes), np.float32), np.float32(1)
        for t in range(steps - 1, -1, -1):
            before, gn, zr, n = kept[t]
            z, r = zr[:H], zr[H:]
            dh += full[:, t]
            its = np.empty((3 * H, lanes), np.float32)
            back = dh * z
            dn = dh - back  # dh * (1 - z)
            np.multiply(back, before - n, out=its[:H])
            its[:H] *= one - z
            dn *= one - n * n
            dr = dn * r
            dg = its.copy()
            dg[2 * H :] = dr
            dr *= gn
            dr *= one - r
            its[H : 2 * H] = dg[H : 2 * H] = dr
            its[2 * H :] = dn
            dG[:, t] = its
            dU += dg @ before.T
            dh = U @ dg
            dh += back
            dh[:, reset[t]] = 0
        grads["U"], grads["B"] = np.ascontiguousarray(dU.T), dG.sum(axis=(1, 2))
        x = X.ravel()
        order = np.argsort(x.astype(np.uint16) if len(self.p["E"]) < 1 << 16 else x, kind="stable")
        first = np.flatnonzero(np.diff(x[order], prepend=-1))
        grads["E"] = dE = np.zeros_like(self.p["E"])
        dE[x[order[first]]] = np.add.reduceat(np.take(dG.reshape(3 * H, -1), order, axis=1, mode="clip"), first, axis=1).T
        scale = np.float32(1.0 / Y.size)
        for g in grads.values():
            g *= scale
        return grads, last, float(-logp.sum(dtype=float))


class Trainer:
    """Adam's steps on windows of documents given in any number.

    Each lane is a stream of documents, one behind the other; the state goes with it from window to window, however
    long a document is, and starts anew at each document. Backpropagation ends at the window's first step.
    """

    def __init__(self, net: Network, expected: float, lanes: int = LANES, rate: float = RATE):
        self.net, self.rate, self.expected, self.t, self.tokens = net, rate, max(1.0, expected), 0, 0
        self.m = {n: np.zeros_like(a) for n, a in net.p.items()}
        self.v = {n: np.zeros_like(a) for n, a in net.p.items()}
        self.lanes = lanes
        self.waiting: list[list[np.ndarray]] = [[] for _ in range(lanes)]
        self.long = np.zeros(lanes, np.int64)
        self.h, self.last = np.zeros((lanes, net.hidden), np.float32), np.zeros(lanes, np.int32)

    def add(self, doc: np.ndarray) -> None:
        """Put a document (tokens, the end last) on the lane with the least to do, and train once all lanes have a few windows."""
        lane = int(self.long.argmin())
        self.waiting[lane].append(doc)
        self.long[lane] += len(doc)
        if lane == 0 and (least := int(self.long.min())) >= 8 * WINDOW:
            self._train(np.arange(self.lanes), least // WINDOW * WINDOW)

    def finish(self) -> Network:
        """Train on what waits: full lanes first, then those that still have something; long remainders of a few lanes are dealt to all, each piece from a state of nought."""
        while (left := np.flatnonzero(self.long)).size:
            if 4 * left.size < self.lanes and self.long[left].max() > 16 * WINDOW:
                left = self._spread(left)
            least = int(self.long[left].min())
            self._train(left, least if least < WINDOW else least // WINDOW * WINDOW)
        return self.net

    def _spread(self, left: np.ndarray) -> np.ndarray:
        size = max(8 * WINDOW, -(-int(self.long.sum()) // (self.lanes - left.size)))
        rest = [(np.concatenate(self.waiting[i]), self.last[i]) for i in left.tolist()]
        pieces = [(r[a : a + size], r[a - 1] if a else before) for r, before in rest for a in range(0, len(r), size)]
        n = len(pieces)
        self.waiting = [[p] for p, _ in pieces] + [[] for _ in range(self.lanes - n)]
        self.long[:n], self.long[n:], self.h[:] = [len(p) for p, _ in pieces], 0, 0
        self.last[:n] = [before for _, before in pieces]
        return np.arange(n)

    def _train(self, lanes: np.ndarray, steps: int) -> None:
        Y = np.empty((steps, len(lanes)), np.int32)
        for i, lane in enumerate(lanes.tolist()):
            tokens = np.concatenate(self.waiting[lane])
            Y[:, i] = tokens[:steps]
            self.waiting[lane] = [tokens[steps:]]
        self.long[lanes] -= steps
        X = np.concatenate([self.last[lanes][None], Y[:-1]])
        start = X == 0  # behind an end token, or first of all
        self.last[lanes] = Y[-1]
        h = self.h[lanes]
        for a in range(0, steps, WINDOW):
            w = slice(a, a + WINDOW)
            grads, h, _ = self.net.gradients(h, X[w], Y[w], start[w])
            self._step(grads, Y[w].size / (WINDOW * self.lanes))
            self.tokens += Y[w].size
        self.h[lanes] = h

    def _step(self, grads: dict[str, np.ndarray], share: float) -> None:
        """A step whose size falls with the tokens seen, and with the share of the lanes that take part."""
        self.t += 1
        rate = self.rate * share * max(0.05, 1 - self.tokens / self.expected)
        norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        clip = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        fix = np.float32(rate * math.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        for n, g in grads.items():
            g *= clip
            m, v = self.m[n], self.v[n]
            m += np.float32(0.1) * (g - m)
            g *= g
            v += np.float32(0.001) * (g - v)
            np.sqrt(v, out=g)
            g += np.float32(1e-8)
            np.divide(m, g, out=g)
            g *= fix
            self.net.p[n] -= g


def averaged(docs: DataFrame, net: Network, parts: int, expected: float, cells: int = 16) -> np.ndarray | None:
    """Documents (row_key, text) are dealt by key to ``parts``, each of ``expected`` tokens about, which train copies of the network in order of their keys; the copies' weights averaged by tokens. The layout of the input plays no part."""
    lanes = int(min(LANES, max(8, expected // (WINDOW * STEPS))))
    shared = docs.sparkSession.sparkContext.broadcast((net.words, net.flat(), net.hidden))
    cuts = np.linspace(0, len(net.flat()), cells + 1).astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, flat, hidden = shared.value
        trainer: Trainer | None = None
        now = None
        for batch in batches:
            for part, t in zip(batch.column("part").to_pylist(), utf8(batch.column("text")), strict=True):
                if part != now:  # the rows of a part follow each other, and a task may have several
                    if trainer is not None:
                        yield weights(now, trainer)
                    now, trainer = part, Trainer(Network(words, hidden).load(flat), expected, lanes)
                trainer.add(words.own_ids(t))
        if trainer is not None:
            yield weights(now, trainer)

    def weights(part: int, trainer: Trainer) -> pa.RecordBatch:
        got = trainer.finish().flat()
        pieces = [got[cuts[i] : cuts[i + 1]].astype("<f4").tobytes() for i in range(cells)]
        return pa.RecordBatch.from_pydict({"part": pa.array([part] * cells, pa.int64()), "cell": pa.array(range(cells), pa.int32()), "tokens": pa.array([trainer.tokens] * cells, pa.int64()), "weights": pa.array(pieces, pa.binary())})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for cell, tokens, w in zip(batch.column("cell").to_pylist(), batch.column("tokens").to_pylist(), batch.column("weights"), strict=True):
                n, total = held.get(cell, (0, 0.0))
                held[cell] = n + tokens, total + tokens * np.frombuffer(w.as_buffer(), "<f4").astype(float)
        for cell, (n, total) in held.items():
            yield pa.RecordBatch.from_pydict({"cell": pa.array([cell], pa.int32()), "weights": pa.array([(total / n).astype("<f4").tobytes()], pa.binary())})

    # a partition a part: dealing by the part's hash would put several into one task
    dealt = docs.select(F.pmod(F.xxhash64("row_key", F.lit(43)), F.lit(parts)).alias("part"), "row_key", "text").repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "row_key")
    copies = dealt.select("part", "text").mapInArrow(run, "part long, cell int, tokens long, weights binary")
    rows = collected(copies.repartitionById(cells, "cell").sortWithinPartitions("cell", "part").select("cell", "tokens", "weights").mapInArrow(summed, "cell int, weights binary"))  # the weights of one network
    if len(rows) < cells:
        return None
    return np.concatenate([np.frombuffer(r["weights"], "<f4") for r in sorted(rows, key=lambda r: r["cell"])])


class Scorer:
    """Log probabilities of whole documents given in any number, in lanes as in training: a long document keeps its lane while others follow one another in the rest, so lanes stay full."""

    def __init__(self, net: Network, lanes: int = SCORE_LANES):
        self.net, self.lanes = net, lanes
        self.waiting: list[list[tuple[np.ndarray, int]]] = [[] for _ in range(lanes)]
        self.long = np.zeros(lanes, np.int64)
        self.h, self.last = np.zeros((lanes, net.hidden), np.float32), np.zeros(lanes, np.int32)
        self.total: dict[int, float] = {}
        self.ended: list[int] = []

    def ready(self) -> list[tuple[int, float]]:
        """Documents that have ended since it was last asked."""
        out = [(k, self.total.pop(k)) for k in self.ended]
        self.ended.clear()
        return out

    def add(self, number: int, doc: np.ndarray) -> None:
        lane = int(self.long.argmin())
        self.waiting[lane].append((doc, number))
        self.long[lane] += len(doc)
        if lane == 0 and (least := int(self.long.min())) >= 2 * SCORE_WINDOW:
            self._run(np.arange(self.lanes), least // SCORE_WINDOW * SCORE_WINDOW)

    def finish(self) -> None:
        """Score what waits. Lanes that have ended drop out; the fewer are left, the longer the windows."""
        while (left := np.flatnonzero(self.long)).size:
            window = min(512, SCORE_WINDOW * self.lanes // left.size)
            self._run(left, min(int(self.long[left].max()), window))

    def _run(self, lanes: np.ndarray, steps: int) -> None:
        Y, doc = np.zeros((len(lanes), steps), np.int32), np.full((len(lanes), steps), -1, np.int64)
        for i, lane in enumerate(lanes.tolist()):
            at, rest = 0, []
            for tokens, number in self.waiting[lane]:
                n = min(len(tokens), steps - at)
                if n:
                    Y[i, at : at + n], doc[i, at : at + n] = tokens[:n], number
                    at += n
                if n < len(tokens):
                    rest.append((tokens[n:], number))
                else:
                    self.ended.append(number)
            self.waiting[lane] = rest
            self.long[lane] -= at
        Y, doc = np.ascontiguousarray(Y.T), np.ascontiguousarray(doc.T)
        X = np.concatenate([self.last[lanes][None], Y[:-1]])
        self.last[lanes] = Y[-1]
        h, start = self.h[lanes], X == 0
        first, many = int(doc[doc >= 0].min()), int(doc.max())
        sums, seen = np.zeros(many - first + 1), np.zeros(many - first + 1, bool)
        window = max(SCORE_WINDOW, SCORE_WINDOW * self.lanes // len(lanes))
        for a in range(0, steps, window):
            w = slice(a, a + window)
            S, h, _ = self.net.states(h, X[w], start[w])
            live = doc[w] >= 0
            its = doc[w][live] - first
            sums += np.bincount(its, self.net.answers(S[:, live], Y[w][live]), len(sums))
            seen[its] = True
        self.h[lanes] = h
        for k in np.flatnonzero(seen).tolist():
            self.total[k + first] = self.total.get(k + first, 0.0) + float(sums[k])


def score_documents(net: Network, ids: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each token array (places of the head, the end last), tokens of the last class by their class alone."""
    scorer = Scorer(net)
    for i, x in enumerate(ids):
        scorer.add(i, np.minimum(x, net.words.known))
    scorer.finish()
    got = dict(scorer.ready())
    return np.array([got[i] for i in range(len(ids))])


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """(row_key, n_tokens, n_head, base_head, model_head, beyond) of (row_key, text): sums of log10 over tokens of the head, and the tokens beyond it."""
    shared = docs.sparkSession.sparkContext.broadcast((net.words, net.flat(), net.hidden))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, flat, hidden = shared.value
        own = Network(words, hidden).load(flat)
        logs = np.append(words.log_count, 0.0)
        none, in_rest = len(words.place), math.log10(max(words.rest, 1e-9))
        scorer = Scorer(own)
        waiting: dict[int, tuple] = {}
        number = 0

        def rows(done: list[tuple[int, float]]) -> pa.RecordBatch:
            told = [(*waiting.pop(k), model / LN10) for k, model in done]
            key, size, head, base, rest, beyond, model = (list(x) for x in zip(*told, strict=True))
            return pa.RecordBatch.from_pydict(
                {
                    "row_key": pa.array(key, pa.int64()),
                    "n_tokens": pa.array(size, pa.int64()),
                    "n_head": pa.array(head, pa.int64()),
                    "base_head": pa.array(base, pa.float64()),
                    "model_head": pa.array([m + r for m, r in zip(model, rest, strict=True)], pa.float64()),
                    "beyond": pa.array([[w.decode() for w in b] for b in beyond], pa.list_(pa.string())),
                }
            )

        for batch in slices(batches):
            for key, t in zip(batch.column("row_key").to_pylist(), utf8(batch.column("text")), strict=True):
                x, beyond = words.ids(t)
                in_last = x >= words.known
                # tokens of the last class: their share of its mass
                waiting[number] = key, len(x), int((x < none).sum()), float(logs[x].sum()), float(logs[x[in_last]].sum() - in_rest * in_last.sum()), beyond
                if words.known:
                    scorer.add(number, np.minimum(x, words.known))
                number += 1
            if done := scorer.ready() if words.known else [(k, 0.0) for k in waiting]:
                yield rows(done)
        scorer.finish()
        if done := scorer.ready():
            yield rows(done)

    return docs.select("row_key", "text").mapInArrow(run, "row_key long, n_tokens long, n_head long, base_head double, model_head double, beyond array<string>")


def head_words(counts: DataFrame, head: int) -> list:
    """The most frequent words, ``head`` at most: those from the lowest count level on from which all fit. Words of one level (a 16th of a doubling) stay together, so nothing is sorted or cut beyond the head."""
    level = F.floor(F.log2("c") * 16).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("level").desc()).collect()  # some hundred levels
    least, held = None, 0
    for row in levels:
        if (held := held + row["n"]) > head:
            break
        least = row["level"]
    if least is None:
        if not levels:
            return []
        # more words share the highest level than the head holds: a share of them by hash, a little below what fits
        room = F.lit(int(0.95 * head / levels[0]["n"] * (1 << 32)))
        return sorted(counts.where((level == levels[0]["level"]) & (F.pmod(F.xxhash64("word"), F.lit(1 << 32)) < room)).collect(), key=lambda r: (-r["c"], r["word"]))
    return sorted(counts.where(level >= least).collect(), key=lambda r: (-r["c"], r["word"]))  # head rows at most


def language_model(docs: DataFrame, head: int = HEAD, known: int = KNOWN, classes: int = CLASSES, hidden: int = HIDDEN, share: int = SHARE, rounds: int = ROUNDS) -> tuple[DataFrame, Network]:
    """Counts of all training tokens of (row_key, text), and the trained network."""
    counts = staged(word_counts(docs), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = head_words(counts.where("word <> ''"), head)
    end = counts.where("word = ''").first()
    words = Words(["", *(r["word"] for r in top)] if end else [], [end["c"], *(r["c"] for r in top)] if end else [], total, distinct, known, classes)
    net = Network(words, hidden)
    if words.known:
        for turn in range(rounds):
            part = docs.where(F.pmod(F.xxhash64("row_key", F.lit(41)), F.lit(share * rounds)) == turn)
            tokens = total / (share * rounds)
            parts = max(1, round(tokens / PART_TOKENS))
            if (weights := averaged(part, net, parts, tokens / parts)) is not None:
                net.load(weights)
    return counts, net


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **settings: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; those held out aren't learnt from."""
    keyed = row_keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    counts, net = language_model(keyed.where(~held_out).select("row_key", "text"), **settings)
    words = net.words
    parts = staged(scored(keyed, net), "scored")
    beyond = parts.select("row_key", F.explode("beyond").alias("word")).groupBy("row_key", "word").agg(F.count(F.lit(1)).alias("n"))
    c = F.coalesce("c", F.lit(0))
    sums = beyond.join(counts, "word", "left").groupBy("row_key").agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("base_beyond"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("n_beyond"))
    norm = math.log10(words.total + 0.5 * (words.distinct + 1))
    rows = parts.drop("beyond").join(sums, "row_key", "left").join(keyed.select("row_key", "doc_id"), "row_key")
    tail = F.coalesce("base_beyond", F.lit(0.0))
    base = F.col("base_head") + tail - F.col("n_tokens") * F.lit(norm)
    return rows.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_beyond", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(words.total)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("model_head") + tail if words.known else base).alias("score"),
    )
