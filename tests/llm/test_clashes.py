"""Columns that bear the names an operator uses inside come back as they were."""

import pytest
from pyspark.sql import functions as F

from docloom.llm import chunk_dedup, cotrain, line_dedup, mixing, ngram_join, pii

NAMES = ("row_key", "_gone", "_spans", "_source", "_text", "_meta", "_copy", "copies", "token", "key")
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize(
    "operator",
    [
        lambda d: line_dedup.dedup_lines(d),
        lambda d: chunk_dedup.dedup_substrings(d),
        lambda d: mixing.mixed(d),
        lambda d: ngram_join.one_of_each(d),
        lambda d: pii.find(d),
        lambda d: cotrain.score(d, cotrain.fit(d, d.sparkSession.createDataFrame([], LABELS))),
    ],
    ids=["lines", "substrings", "mixing", "near", "pii", "quality"],
)
def test_names_come_back(spark, odd, operator):
    named = odd.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in NAMES})
    out = operator(named)
    assert set(named.columns) <= set(out.columns)
    for r in out.collect():
        assert all(r[n] == (None if r["doc_id"] is None else f"{n}{r['doc_id']}") for n in NAMES)
