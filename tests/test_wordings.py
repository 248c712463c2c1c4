import pytest
from pyspark.sql import functions as F

from docloom.operators import structured
from docloom.plans import load_catalogue


@pytest.mark.parametrize("name", ["fact_relation_keys", "fact_errors"])
def test_wordings_are_counted_before_they_are_read(spark, sf, name):
    plan = load_catalogue().QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") > plan.index("ArrowEvalPython")


def test_columns_of_wordings_are_made_once_each(spark):
    facts = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", "x"), (4, None, "x"), (5, None, "x")], "id int, p string, q string")
    sizes = []

    def told(wordings):
        sizes.append(wordings.count())
        return wordings.withColumn("n", F.concat_ws("-", "p", "q"))

    assert sorted((r["id"], r["n"]) for r in structured.by_wording(facts, ["p", "q"], told).collect()) == [(1, "a"), (2, "a"), (3, "a-x"), (4, "x"), (5, "x")]
    assert sizes == [3]
