"""Documents with the cases that every operator must stand."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(draw: random.Random, n: int, words: int = 4000) -> str:
    return " ".join(f"w{draw.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, repeated rows, ties, a very long text, accents and controls."""
    draw = random.Random(3)
    long = "\n".join(sentence(draw, 12) for _ in range(3000))
    same = sentence(draw, 80)
    rows = [
        (1, None, "en", "a", 3),
        (2, "", "de", "b", None),
        (3, " \t\n\x0b ", None, None, 5),
        (4, same, "en", "a", len(same)),
        (4, same, "en", "a", len(same)),
        (5, same, "en", None, len(same)),
        (6, long, "en", "a", len(long)),
        (7, "Größe naïve 日本語 \U0001f600 é\x00x", "fr", "b", 9),
        (None, "one two three four five six", "en", "c", 27),
        (8, "word", None, "c", None),
        (9, "One Two", "en", "c", 7),
    ]
    return rows + [(100 + i, sentence(draw, draw.randrange(20, 90)), "en", draw.choice("abc"), 100) for i in range(40)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
