import pytest
from pyspark.sql import functions as F

from docloom.operators import lexical
from docloom.plans import load_catalogue
from docloom.sources import writers


@pytest.mark.parametrize("name", ["scoped_rank_per_group", "bm25_with_unmatched"])
def test_ranked_lists_make_no_rows_of_postings(spark, sf, name):
    plan = load_catalogue().QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "tfs#" in plan and " tf#" not in plan and "[tf#" not in plan


def test_an_index_is_blocks_alone(spark, tmp_path):
    docs = spark.createDataFrame([(3, "a b a"), (1, "b"), (2, ""), (4, None)], "id int, text string")
    tokens = lexical.ascii_tokens(F.col("text"))
    index = writers.write_postings(docs, "id", tokens, f"file://{tmp_path}/x")
    assert not (tmp_path / "x" / "postings").exists()
    assert {tuple(r) for r in index.postings.collect()} == {("a", 3, 2, 3), ("b", 3, 1, 3), ("b", 1, 1, 1)}
    assert {tuple(r) for r in index.terms.collect()} == {("a", 1), ("b", 2)}
    assert tuple(index.corpus.first()) == (4, 1.0)
