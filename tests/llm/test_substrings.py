import random

import numpy as np
import pytest

from docloom.llm import chunk_dedup
from docloom.llm.chunk_dedup import dedup_substrings, ends, rolling

SCHEMA = "doc_id long, text string"


def gear_hash(raw: bytes) -> list[int]:
    table, h, out = chunk_dedup.gear(chunk_dedup.SEED).tolist(), 0, []
    for b in raw:
        h = (h << 1) + table[b] & 0xFFFFFFFF
        out.append(h)
    return out


def cut(raw: bytes) -> list[bytes]:
    h = gear_hash(raw)
    out, at = [], 0
    for i in range(len(raw)):
        size = i + 1 - at
        if size == chunk_dedup.MOST or size >= chunk_dedup.LEAST and h[i] % (1 << chunk_dedup.BITS) == 0:
            out.append(raw[at : i + 1])
            at = i + 1
    return out + ([raw[at:]] if at < len(raw) else [])


def test_rolling_hash_and_ends():
    draw = random.Random(1)
    raw = bytes(draw.randrange(256) for _ in range(5000))
    assert rolling(np.frombuffer(raw, np.uint8)).tolist() == gear_hash(raw)
    got = ends(rolling(np.frombuffer(raw, np.uint8)), 0, len(raw), chunk_dedup.LEAST, chunk_dedup.BITS, chunk_dedup.MOST)
    assert got == np.cumsum([len(c) for c in cut(raw)]).tolist()


def brute(rows):
    """Texts that came before, and runs of chunks seen before, extended by the bytes around the first place of their first and last chunk."""
    seen, texts, out, raws = {}, set(), {}, {}
    for d, text in rows:
        raw = raws[d] = (text or "").encode()
        if raw and raw in texts:
            out[d] = [(0, len(raw))]
            continue
        texts.add(raw)
        at, runs = 0, []
        for c in cut(raw):
            if c in seen:
                e, a = seen[c]
                if runs and runs[-1][1] == at:
                    runs[-1][1:] = [at + len(c), runs[-1][2], (e, a + len(c))]
                else:
                    runs.append([at, at + len(c), (e, a), (e, a + len(c))])
            seen.setdefault(c, (d, at))
            at += len(c)
        grown = []
        for a, b, (e, x), (f, y) in runs:
            for _ in range(chunk_dedup.RIM):
                if a and x and raw[a - 1] == raws[e][x - 1]:
                    a, x = a - 1, x - 1
            for _ in range(chunk_dedup.RIM):
                if b < len(raw) and y < len(raws[f]) and raw[b] == raws[f][y]:
                    b, y = b + 1, y + 1
            grown.append((a, b))
        merged = []
        for a, b in sorted(grown):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out[d] = [(a, b) for a, b in merged if b - a >= chunk_dedup.MIN_BYTES]
    return out


def test_brute_force(spark):
    draw = random.Random(2)
    letters = "abcdefghijklmnop "
    text = lambda n: "".join(draw.choice(letters) for _ in range(n))
    shared = [text(draw.randrange(150, 900)) for _ in range(5)]
    rows = [(i, text(draw.randrange(0, 800)) + draw.choice([*shared, ""]) + text(draw.randrange(0, 300)) + draw.choice([*shared, ""])) for i in range(60)]
    rows += [(90, None), (91, ""), (92, "z" * 3000), (93, "z" * 3000)]
    rows += [(100 + i, draw.choice(["short text", "another short text", "a text of some sixty bytes, which has more than one chunk, likely"])) for i in range(12)]
    got = {r["doc_id"]: r for r in dedup_substrings(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    for d, text_ in rows:
        assert [(s["start"], s["end"]) for s in got[d]["spans"]] == want[d], d
        left = (text_ or "").encode()
        for a, b in reversed(want[d]):
            left = left[:a] + left[b:]
        assert (got[d]["text"] or "") == left.decode()
        assert got[d]["removed_bytes"] == len((text_ or "").encode()) - len(left)


@pytest.mark.parametrize("shift", [0, 1, 7, 100])
def test_an_insertion_moves_only_its_rims(spark, shift):
    draw = random.Random(shift)
    passage = " ".join(f"word{draw.randrange(10**6)}" for _ in range(60))  # over 50 words
    rows = [(1, "a" * 40 + " " + passage + " tail"), (2, "b" * shift + passage + " other end"), (3, "clean text of its own, " * 3)]
    got = {r["doc_id"]: r for r in dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1]["removed_bytes"] == 0 and got[3]["removed_bytes"] == 0
    assert got[2]["removed_bytes"] >= len(passage)
    assert got[2]["copied_from"] == [1]


def test_passages_of_just_over_fifty_short_words(spark):
    """Nearly all of their bytes go, and nothing else."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, size = [], []
    for i in range(300):
        passage = prose(51)
        size.append(len(passage))
        rows += [(2 * i, f"{prose(20)} {passage} {prose(20)}"), (2 * i + 1, f"{prose(31)} {passage} {prose(9)}")]
    got = {r["doc_id"]: r["removed_bytes"] for r in dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[2 * i] for i in range(300))
    assert sum(got[2 * i + 1] for i in range(300)) >= 0.95 * sum(size)
    assert sum(got[2 * i + 1] > 0 for i in range(300)) >= 297
    assert all(got[2 * i + 1] <= size[i] + 4 for i in range(300))  # the blanks around, and a letter by chance


def test_equal_texts_go_wherever_their_chunks_came_first(spark):
    """Short texts given twice whose halves also stand in earlier texts."""
    draw = random.Random(6)
    half = lambda: " ".join(f"w{draw.randrange(10**5)}" for _ in range(7))
    rows = []
    for i in range(200):
        a, b = half(), half()
        rows += [(10 * i, f"{a} {half()}"), (10 * i + 1, f"{a} {b}"), (10 * i + 2, f"{a} {b}")]
    rows += [(5000 + i, "x" * 97) for i in range(3)]
    got = {r["doc_id"]: r for r in dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[10 * i + 2]["text"] == "" and got[10 * i + 2]["copied_from"] == [10 * i + 1] for i in range(200))
    assert all(got[10 * i + 1]["text"] != "" and got[10 * i]["removed_bytes"] == 0 for i in range(200))
    assert [got[5000 + i]["text"] for i in range(3)] == ["x" * 97, "", ""]


def test_what_is_deleted_stands_elsewhere(spark):
    """Chains of copies: every passage is still in some text, but for letters at its ends that neighbours share by chance."""
    draw = random.Random(12)
    bits = [" ".join(f"k{draw.randrange(10**6)}" for _ in range(25)) for _ in range(20)]
    rows = [(i, " ".join(draw.choice(bits) for _ in range(draw.randrange(1, 6)))) for i in range(120)]
    got = dedup_substrings(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    left = " ".join(r["text"] for r in got)
    assert all(b[8:-8] in left for b in bits if any(b in t for _, t in rows))


def test_whole_characters(spark):
    draw = random.Random(8)
    body = "".join(draw.choice("日本語を書く\U0001f600é") for _ in range(400))
    rows = [(1, "x" + body), (2, "yy" + body + "z")]
    got = {r["doc_id"]: r["text"] for r in dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == "x" + body
    assert len(got[2]) < len(body) / 2 and "�" not in got[2]


def test_odd_rows(spark, odd, odd_rows, empty):
    out = dedup_substrings(odd.withColumnRenamed("lang", "spans"))
    assert out.columns == ["doc_id", "text", "source", "n_chars", "removed_bytes", "spans", "copied_from"]
    assert out.count() == len(odd_rows)
    assert out.where("removed_bytes > 0").count() == 2  # two of three copies
    assert dedup_substrings(empty).count() == 0
