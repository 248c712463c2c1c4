"""Personal data: candidate spans of high recall, scored by gradient-boosted trees, selected by calibrated thresholds.

Base rules (email, ip, card, phone) always stand. Wider generators propose further, overlapping spans:
written-out addresses, numbers without a country code, identity numbers and secrets. Boosted trees
score these by format and context; for each kind a threshold on the calibrated score is set on
held-out examples for the wanted precision; overlaps go to the better score, and base spans win.

No labelled personal data exists to train on: the trees are fitted on the driver to a fixed number of
examples written by a generator of formats, true and misleading ones, in invented context. Scoring
is local to a document.

Defined cases: a null text counts as an empty one; an empty text has no spans; whole texts are
searched, in time linear in their length; rows with the same id stay separate; other columns are
kept save one named like the output.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import slices

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("address", "identity", "number", "secret")
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()), T.StructField("score", T.DoubleType())])

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the base rules, leftmost and non-overlapping within a kind, by kind and start."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        past = 0
        for m in _DOMAIN.finditer(text):
            start = at = m.start()
            while start > past and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                past = m.end()
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(part := p.lstrip("0")) <= 3 and int(part or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


#: Kind, what a text must hold for the pattern to match at all, and the pattern. Tokens run to their end, however long.
_GENERATORS: tuple[tuple[str, str, re.Pattern], ...] = (
    ("address", "at", re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]++\s?(?:\[at\]|\(at\)|(?<=\s)at(?=\s))\s?[A-Za-z0-9-]++(?:\s?(?:\[dot\]|\(dot\)|(?<=\s)dot(?=\s)|\.)\s?[A-Za-z]{2,}+)+", re.I)),
    ("number", "digit", re.compile(r"(?<![\w.+])\(?[0-9]{2,4}\)?(?:[-. /][0-9]{2,4}){1,4}(?![\w])")),
    ("number", "digit", re.compile(r"(?<![\w.+])0[0-9]{8,11}(?!\w)")),
    ("identity", "digit", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("identity", "digit", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("identity", "digit", re.compile(r"(?<![\w-])[0-9](?:[ -]?[0-9]){11,18}(?![\w-])")),
    ("secret", "sign", re.compile(r"(?<!\w)(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[^\s\"']{6,}+", re.I)),
    ("secret", "", re.compile(r"(?<![A-Za-z0-9])[A-Z]{4}[A-Z0-9]{16}(?![A-Za-z0-9])")),
    ("secret", "digit", re.compile(r"(?<![A-Za-z0-9/+_-])(?=[A-Za-z/+_-]*+[0-9])[A-Za-z0-9/+_-]{24,}+={0,2}(?![A-Za-z0-9/+_=-])")),
)
_AT = re.compile(r"\[at\]|\(at\)|\sat\s", re.I)
_CUES = tuple(tuple(x.split()) for x in ("phone tel call mobile fax contact ring", "ssn social tax iban passport id account", "password passwd pwd token secret key access credential login", "mail email write reach contact", "version release section page chapter isbn order invoice part ref build"))
_KIND_CUE = {"number": 0, "identity": 1, "secret": 2, "address": 3}
CONTEXT = 40


def proposed(text: str) -> list[tuple[str, int, int]]:
    """Candidates of the wide generators; they may overlap."""
    holds = {"": True, "digit": bool(_DIGIT.search(text)), "at": bool(_AT.search(text)), "sign": "=" in text or ":" in text}
    return [(kind, *m.span()) for kind, cue, p in _GENERATORS if holds[cue] for m in p.finditer(text)]


def entropy(s: str) -> float:
    counts = np.unique(np.frombuffer(s.encode("utf-32-le"), "<u4"), return_counts=True)[1] / len(s)
    return float(-(counts * np.log2(counts)).sum())


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span, then its context."""
    s = text[start:end]
    digits = _digits(s)
    letters = sum(c.isalpha() for c in s)
    upper = sum(c.isupper() for c in s)
    groups = re.findall("[0-9]+", s)
    runs = re.findall(r"[A-Za-z]+|[0-9]+", s)
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    words = set(re.findall("[a-z]+", before))
    lead = re.match("[A-Za-z_-]+", s)
    inner = (lead.group().lower() if lead else "").replace("_", " ").replace("-", " ")
    cues = [float(any(w in words or w in inner.split() for w in cue)) for cue in _CUES]
    return [
        float(ADDED_KINDS.index(kind)), float(len(s)), float(len(digits)), letters / len(s), upper / max(1, letters), float(len(groups)),
        float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)), float(len(groups[-1]) if groups else 0), len(runs) / len(s),
        entropy(s), float(s.count("-")), float(s.count(".")), float(s.count(" ")), float("(" in s), float("=" in s or ":" in s),
        float(luhn(digits)) if digits else 0.0, float(len(set(digits))), float(digits[:4] in ("1900", "2000") or bool(re.match("(19|20)[0-9]{2}[-./]", s))),
        float(bool(re.search(r"\[at\]|\(at\)|\[dot\]|\(dot\)", s, re.I))), *cues, cues[_KIND_CUE[kind]],
        float(before[-1:].isspace() or not before), float(after[:1].isspace() or not after), float(before.rstrip()[-1:] in (":", "#", "$", "=")), float("/" in s),
    ]


class Trees:
    """Boosted regression trees of fixed depth for the logistic loss, on binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, X: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(X[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for j in range(X.shape[1])]
        B = np.stack([np.searchsorted(c, X[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        self.start = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
        f = np.full(len(y), self.start)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        inner = (1 << self.depth) - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            column, cut, at = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
            for node in range(inner):
                rows = np.flatnonzero(at == node)
                best = 1e-9
                if len(rows) >= 8:
                    G, H = g[rows].sum(), h[rows].sum()
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        left_g = np.bincount(B[rows, j], g[rows], len(c) + 1).cumsum()[:-1]
                        left_h = np.bincount(B[rows, j], h[rows], len(c) + 1).cumsum()[:-1]
                        gain = left_g**2 / (left_h + self.ridge) + (G - left_g) ** 2 / (H - left_h + self.ridge) - G**2 / (H + self.ridge)
                        if gain[k := int(gain.argmax())] > best:
                            best, column[node], cut[node] = gain[k], j, c[k]
                at[rows] = 2 * node + 1 + (X[rows, column[node]] > cut[node])
            leaf = at - inner
            value = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge)
            f += value[leaf]
            self.trees.append((column, cut, value))
        return self

    def margin(self, X: np.ndarray) -> np.ndarray:
        f = np.full(len(X), self.start)
        rows, inner = np.arange(len(X)), (1 << self.depth) - 1
        for column, cut, value in self.trees:
            at = np.zeros(len(X), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (X[rows, column[at]] > cut[at])
            f += value[at - inner]
        return f


def _examples(n: int, seed: int) -> tuple[list[tuple[str, str, int, int]], np.ndarray]:
    """n candidates (text, kind, start, end) written in invented context, and whether each is personal or secret."""
    draw = np.random.default_rng(seed)
    pick = lambda xs: xs[int(draw.integers(len(xs)))]
    digits = lambda k: "".join(map(str, draw.integers(0, 10, k)))
    chars = lambda k, a: "".join(pick(a) for _ in range(k))
    low, hexa, base64, caps = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    word = lambda: chars(int(draw.integers(2, 9)), low)
    cue = lambda *w: pick([*w, *w, word()])
    local = lambda: "".join(word() for _ in range(pick([1, 1, 2, 12])))
    gap = lambda: pick([" ", " ", ""])
    true = (
        lambda: (cue("phone", "call", "tel:", "mobile"), f"({digits(3)}) {digits(3)}-{digits(4)}"),
        lambda: (cue("phone", "call", "tel:", "contact"), f"{digits(3)}-{digits(3)}-{digits(4)}"),
        lambda: (cue("tel:", "fax", "mobile"), f"0{digits(3)} {digits(3)} {digits(4)}"),
        lambda: (cue("mail", "write to", "email"), f"{local()}{pick(['.', '_', ''])}{word()}{(g := gap())}[at]{g}{word()}{g}[dot]{g}{pick(['com', 'org', 'net', 'de'])}"),
        lambda: (cue("mail", "reach me", "email"), f"{local()}(at){word()}.{pick(['com', 'org', 'net'])}"),
        lambda: (cue("mail", "email"), f"{word()} at {word()} dot {pick(['com', 'org', 'net'])}"),
        lambda: (cue("ssn", "social"), f"{digits(3)}-{digits(2)}-{digits(4)}"),
        lambda: (cue("iban", "account"), f"{pick(['DE', 'FR', 'ES', 'GB'])}{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}"),
        lambda: (word(), f"{pick(['password', 'pwd', 'token', 'secret', 'api_key'])}{pick(['=', ': ', ' = '])}{pick(['', chr(34)])}{chars(int(draw.integers(8, 41)), pick([hexa, base64]))}"),
        lambda: (cue("key", "access"), "AKIA" + chars(16, caps)),
        lambda: (cue("key", "token", "secret"), chars(int(draw.integers(32, 49)), base64)),
        lambda: (cue("token", "secret"), chars(40, hexa)),
    )
    false = (
        lambda: (cue("version", "release", "build"), f"{digits(2)}.{digits(2)}.{digits(2)}"),
        lambda: (cue("on", "dated", "since"), f"20{digits(2)}-{digits(2)}-{digits(2)}"),
        lambda: (cue("on", "dated", "until"), f"{digits(2)}/{digits(2)}/20{digits(2)}"),
        lambda: (cue("page", "section", "pages"), f"{digits(2)}-{digits(2)}"),
        lambda: (cue("order", "invoice", "ref", "part"), f"{digits(12)}"),
        lambda: (cue("isbn", "ref"), f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}"),
        lambda: (cue("of", "the", "about"), f"{digits(3)}.{digits(3)}.{digits(3)}"),
        lambda: (cue("between", "years"), f"19{digits(2)}-20{digits(2)}"),
        lambda: (word(), "-".join(word() for _ in range(6)) + "-" + digits(1)),
        lambda: (word(), "/" + "/".join(word() for _ in range(6)) + digits(2)),
        lambda: (cue("at", "from"), f"{word()} at {word()}. {word().capitalize()}"),
        lambda: (word(), f"{word()} (at) the {word()}. {word()}"),
        lambda: (word(), f"key: {word()}{word()}"),
        lambda: (word(), "".join(word().capitalize() for _ in range(6)) + digits(1)),
    )
    rows: list[tuple[str, str, int, int]] = []
    y: list[float] = []
    while len(rows) < n:
        good = bool(draw.integers(2))
        lead, body = pick(true if good else false)()
        head = " ".join(word() for _ in range(int(draw.integers(1, 8)))) + f" {lead} "
        text = f"{head}{body}{pick(['', '.', ','])} " + " ".join(word() for _ in range(int(draw.integers(1, 8))))
        for kind, start, end in proposed(text):
            if min(end, len(head) + len(body)) - max(start, len(head)) >= 0.8 * max(end - start, len(body)):
                rows.append((text, kind, start, end))
                y.append(float(good))
    return rows, np.array(y)


class Model:
    """Trees, Platt's calibration of their margin, and a threshold on the calibrated score for each kind."""

    def __init__(self, examples: int = 6000, seed: int = 5, precision: float = 0.995):
        rows, y = _examples(examples, seed)
        X = np.array([features(*r) for r in rows])
        part = np.arange(len(y)) % 3  # trees, calibration, thresholds
        self.trees = Trees().fit(X[part == 0], y[part == 0])
        m, t = self.trees.margin(X[part == 1]), y[part == 1]
        a, b = 1.0, 0.0
        for _ in range(25):  # Newton's steps for the logistic fit of t on the margin
            p = 1 / (1 + np.exp(-(a * m + b)))
            w = p * (1 - p) + 1e-6
            H = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(H, np.array([((t - p) * m).sum(), (t - p).sum()]))
            a, b = a + step[0], b + step[1]
        self.a, self.b = a, b
        self.held_out = (X[part == 2], y[part == 2])
        score = self.score(X[part == 2])
        self.threshold: dict[str, float] = {}
        for i, kind in enumerate(ADDED_KINDS):
            its = X[part == 2][:, 0] == i
            s, t = score[its], y[part == 2][its]
            order = np.argsort(-s)
            right = np.cumsum(t[order]) / np.arange(1, len(s) + 1)
            good = np.flatnonzero(right >= precision)
            self.threshold[kind] = max(0.5, float(s[order][good[-1]])) if len(good) else 1.1

    def score(self, X: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a * self.trees.margin(X) + self.b)))


@lru_cache(maxsize=2)
def default_model(seed: int = 5) -> Model:
    return Model(seed=seed)


def all_spans(text: str, model: Model) -> list[tuple[str, int, int, bool, float]]:
    """Base spans, then added ones, each by kind and start."""
    base = base_spans(text)
    candidates = proposed(text)
    added: list[tuple[str, int, int, bool, float]] = []
    if candidates:
        taken = bytearray(len(text))
        for _, s, e in base:
            taken[s:e] = b"\1" * (e - s)
        candidates = [c for c in candidates if not any(taken[c[1] : c[2]])]
    if candidates:
        score = model.score(np.array([features(text, *c) for c in candidates]))
        for i in sorted(range(len(candidates)), key=lambda i: (-score[i], candidates[i][1] - candidates[i][2], candidates[i])):
            kind, s, e = candidates[i]
            if score[i] >= model.threshold[kind] and not any(taken[s:e]):
                taken[s:e] = b"\1" * (e - s)
                added.append((kind, s, e, False, float(score[i])))
    added.sort(key=lambda x: (ADDED_KINDS.index(x[0]), x[1]))
    return [(k, s, e, True, 1.0) for k, s, e in base] + added


def find(docs: DataFrame, text: str = "text", spans: str = "spans", model: Model | None = None) -> DataFrame:
    """docs with ``spans``: array of (kind, start, end, base, score), offsets in code points, end exclusive."""
    fitted = docs.sparkSession.sparkContext.broadcast(model or default_model())
    docs = docs.drop(spans)
    schema = T.StructType([*docs.schema.fields, T.StructField(spans, T.ArrayType(SPAN))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))
    names = [f.name for f in SPAN.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = fitted.value
        for batch in slices(batches, text):
            found = [[dict(zip(names, s, strict=True)) for s in all_spans(t or "", own)] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, spans])

    return docs.mapInArrow(run, schema)


def redact(found: DataFrame, text: str = "text", spans: str = "spans", target: str = "text") -> DataFrame:
    """Replace each span by its kind in brackets; overlapping spans count once, under the first kind."""
    by_start = F.array_sort(F.col(spans), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))).otherwise(
        F.struct(F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))
    )
    done = F.aggregate(by_start, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text)))))
    return found.withColumn(target, F.when(F.size(spans) > 0, done).otherwise(F.col(text)))
