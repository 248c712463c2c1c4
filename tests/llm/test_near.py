import random
import re

import pytest
from tests.llm.conftest import sentence

from docloom.llm import ngram_join
from docloom.llm.components import components
from docloom.llm.ngram_join import one_of_each, similar_documents

SCHEMA = "doc_id long, text string"


def fold(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, words):
    w = fold(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(rows, words, p, q):
    sets = [shingles(t, words) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and q * len(a & b) >= p * len(a | b):
                label[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def varied(seed, groups=12):
    """Chains and groups of near copies with edits around the threshold, a common passage, and singles."""
    draw = random.Random(seed)
    passage = sentence(draw, 30, 50)
    rows = []
    for _ in range(groups):
        base = sentence(draw, draw.randrange(5, 120), draw.choice([20, 4000])).split()
        if draw.random() < 0.4:
            base = base[: draw.randrange(1, 10)] + passage.split()
        for _ in range(draw.choice([1, 2, 5, 25])):
            for _ in range(draw.randrange(0, 3)):
                base = list(base)
                base[draw.randrange(len(base))] = f"x{draw.randrange(9000)}"
            text = " ".join(base)
            rows.append((len(rows) * 3 + 1, text.upper() if draw.random() < 0.2 else text))
    rows += [(len(rows) * 3 + 1, None), (len(rows) * 3 + 2, ""), (len(rows) * 3 + 3, "a b"), (len(rows) * 3 + 4, "A  b")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "words", "p"), [(1, 3, 90), (2, 5, 80), (3, 1, 50), (4, 3, 100)])
def test_brute_force(spark, seed, words, p):
    rows = varied(seed)
    got = sorted(map(tuple, similar_documents(spark.createDataFrame(rows, SCHEMA), words, p, 100).collect()), key=str)
    assert got == brute(rows, words, p, 100)


def test_large_buckets(spark, monkeypatch):
    """Leaders and the exact rest give the same as all pairs."""
    monkeypatch.setattr(ngram_join, "SMALL", 2)
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    rows = varied(9, 10)
    got = sorted(map(tuple, similar_documents(spark.createDataFrame(rows, SCHEMA), 3, 80, 100).collect()), key=str)
    assert got == brute(rows, 3, 80, 100)


@pytest.mark.parametrize(("words", "p", "n"), [(3, 90, 11), (5, 80, 8), (1, 50, 1)])
def test_one_word_more(spark, words, p, n):
    """A set whose prefix is one token links with one that holds an element more: 9 of 10 shingles at 0.9, 4 of 5 at 0.8."""
    text = [f"w{i}" for i in range(n)]
    rows = [(1, " ".join([*text, "after"])), (2, " ".join(text)), (3, " ".join(["before", *text])), (4, "quite another text of some eleven words that share nothing here")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, similar_documents(docs, words, p, 100).collect()), key=str)
    assert got == brute(rows, words, p, 100)
    assert [c for _, _, c in got] == [1, 1, 1, 4]
    assert sorted(r["doc_id"] for r in one_of_each(docs, words, p, 100).collect()) == [1, 4]


def test_reachable():
    """Sizes left out of the join are those of which no unlike set can be similar."""
    for p in (1, 50, 77, 80, 90, 99, 100):
        limit = ngram_join.Threshold(p, 100)
        for n in range(1, 130):
            unlike = [(n, n + 1)] + ([(n - 1, n)] if n > 1 else [])  # least differences: a superset and a subset of one element
            assert limit.reachable(n) == any(100 * a >= p * b for a, b in unlike)


def test_odd_rows(spark, odd, odd_rows, empty):
    got = sorted(map(tuple, similar_documents(odd, 3, 90, 100).collect()), key=str)
    assert got == brute([(i, t) for i, t, *_ in odd_rows], 3, 90, 100)
    assert similar_documents(empty).count() == 0
    kept = one_of_each(odd)
    assert kept.columns == odd.columns
    # one of the three copies stays, and all without shingles
    assert kept.count() == len(odd_rows) - 2


def test_components(spark):
    draw = random.Random(4)
    for n in (1, 40, 300):
        edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(n)] + [(1000 + i, 1001 + i) for i in range(40)]
        label: dict = {}

        def find(x, label=label):
            while label.setdefault(x, x) != x:
                x = label[x]
            return x

        for a, b in edges:
            if a != b:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
        got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
        assert got == {x: find(x) for x in label}
