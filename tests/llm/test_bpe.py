import hashlib
import json
import random
import struct

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docloom.llm import bpe
from docloom.llm.q_tokens import op1_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
REAL = Tokenizer.from_file(PATH)
OWN = bpe.Coder(open(PATH, encoding="utf-8").read())


def real(text: str) -> tuple[bytes, str]:
    ids = REAL.encode(text, add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids), REAL.decode(ids, skip_special_tokens=False)


def check(text: str) -> None:
    packed, decoded = real(text)
    assert OWN.encode(text) == packed
    assert OWN.decode(packed) == decoded


@settings(max_examples=400, deadline=None)
@given(st.text())
def test_any_text(text):
    check(text)


def test_blanks_contractions_and_specials():
    blanks = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    draw = random.Random(1)
    parts = [*blanks, "a", "B", "'s", "'t", "'ll", "'", "7", "12", "é", "é", "²", "Ⅷ", "日本", "\U0001f600", "!", "--", "<|endoftext|>", "<|endof", "\x1c", "\x85", "᠎", "​", "﻿"]
    for _ in range(4000):
        check("".join(draw.choice(parts) for _ in range(draw.randrange(1, 12))))


def test_one_very_long_word():
    check("ab" * 30_000)
    check("a" * 20_000)


def test_other_vocabularies_are_refused():
    spec = json.load(open(PATH, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": spec["model"] | {"byte_fallback": True}}):
        with pytest.raises(ValueError, match="not a plain"):
            bpe.refuse_others(spec | change)


def test_a_small_cache_changes_no_id(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 7)
    coder = bpe.Coder(open(PATH, encoding="utf-8").read())
    text = " ".join(f"word{i % 23} été{i % 5}!" for i in range(500))
    assert coder.encode(text) == real(text)[0] and len(coder) <= 7


def test_query_agrees_with_the_library(spark, sf):
    got = {r["doc_id"]: r for r in op1_bpe(spark, sf).collect()}
    rows = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(rows) == len(got)
    for row in rows:
        packed, decoded = real(row["text"] or "")
        its = got[row["doc_id"]]
        assert its["n_tokens"] == len(packed) // 4
        assert its["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        assert its["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_odd_rows_and_clashing_names(spark, odd, odd_rows, empty):
    named = odd.withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded")
    out = bpe.decode(bpe.encode(named, PATH), PATH)
    assert out.columns == ["doc_id", "text", "n_chars", "ids", "decoded"]
    got = sorted((r["doc_id"] or -1, r["decoded"]) for r in out.collect())
    assert got == sorted((i if i is not None else -1, t or "") for i, t, *_ in odd_rows)
    both = bpe.encode_and_decode(named, PATH)
    assert both.columns == out.columns and sorted((r["doc_id"] or -1, r["decoded"], r["ids"]) for r in both.collect()) == sorted((r["doc_id"] or -1, r["decoded"], r["ids"]) for r in out.collect())
    assert bpe.encode(empty, PATH).count() == 0 and bpe.encode_and_decode(empty, PATH).count() == 0


def test_id_array(spark):
    df = bpe.encode(spark.createDataFrame([("hello world",), (None,)], "text string"), PATH)
    got = [r["a"] for r in df.select(bpe.id_array().alias("a")).collect()]
    assert got == [REAL.encode("hello world").ids, []]


def test_latin_texts_are_cut_into_pretokens():
    """No chunk with its punctuation is kept beside its pre-tokens, and the pattern for Latin letters cuts as that of the vocabularies."""
    own = bpe.Coder(open(PATH, encoding="utf-8").read())
    text = "été, l'été&&& 12½ x²—’n\t\n  don't"
    assert own.encode(text) == real(text)[0]
    assert set(own) == set(own.pieces(text)) and "été," not in own
    draw = random.Random(4)
    signs = [*map(chr, range(0x250)), *"–—’…“”", *("     '''stmdrevl \n\t\xa0" * 8)]
    for _ in range(3000):
        odd = "".join(draw.choices(signs, k=draw.randrange(1, 14)))
        assert (bpe._OTHER.search(odd) or bpe.cut(odd) == own.pieces(odd)) and OWN.encode(odd) == real(odd)[0]
