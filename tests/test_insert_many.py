from pyspark.sql import functions as F

from docloom.plans import load_catalogue


def test_buyers_numbers_may_be_customers_numbers(spark, tmp_path):
    """As many customers as have numbers of more than 100,000: buyers are still told, once each."""
    spark.createDataFrame([(1, 7), (100_001, 8)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "P"), (1, "P"), (2, "P"), (3, "F")], "o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    rows = load_catalogue().QUERIES["insert_ignore"](spark, str(tmp_path)).select("k", F.col("v")).collect()
    assert sorted(tuple(r) for r in rows if r["v"] is not None) == [(1, 7), (100_001, 8)]
    assert sorted(r["k"] for r in rows if r["v"] is None) == [100_001, 100_002]
