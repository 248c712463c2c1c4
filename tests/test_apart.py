from pyspark.sql import functions as F

from docloom.operators import lane_rules
from docloom.session import apart


def test_each_table_is_written_by_itself(spark):
    one, two = spark.range(3), spark.range(5)
    got = apart((x for x in (one.join(two, "id"), two.join(one, "id", "left_anti"))), "tests")
    assert sorted(r["id"] for r in got.collect()) == [0, 1, 2, 3, 4]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_rules_share_no_plan(spark):
    facts = spark.createDataFrame([], ", ".join(["document string", "fact int", *(f"{f} string" for f in lane_rules.FIELDS)]))
    scopes = spark.createDataFrame([], "document string, fact int, header_ids array<string>, row_ids array<string>, line_ids array<string>")
    spans = spark.createDataFrame([], "document string, fact int, field string, line_id string, start int, end int")
    lines = spark.createDataFrame([], "document string, line_id string, text string")
    got = lane_rules.relation_violations(facts, facts, scopes, spans, lines)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString() and got.where(F.lit(True)).count() == 0
