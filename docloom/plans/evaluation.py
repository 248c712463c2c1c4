"""Queries of evaluation and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import lexical, lineage, metrics
from docloom.plans.catalogue import query, read
from docloom.plans.retrieval import _BM25_SQL, _keyword_top


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return _keyword_top(spark, sf, 10)


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    """One document for each query: the first good one of its number's residue."""
    labels = read(spark, sf, "labels").where("quality = 1").select("doc_id")
    items = read(spark, sf, "benchmark").select(F.col("item_id").alias("query"))
    return items.join(labels, F.col("query") == F.col("doc_id") % 40).groupBy("query").agg(F.min("doc_id").alias("doc"))


_TOP = f"{_BM25_SQL}, top AS (SELECT query, doc, rank FROM kw WHERE rank <= 10), gold AS (SELECT item_id AS query, min(doc_id) AS doc FROM benchmark JOIN labels ON item_id = doc_id % 40 AND quality = 1 GROUP BY 1), r AS (SELECT g.query, min(rank) AS rank FROM gold g LEFT JOIN top t ON t.query = g.query AND t.doc = g.doc GROUP BY 1)"


@query("recall_mrr_ndcg", f"WITH {_TOP} SELECT count(*) AS n, round(avg((coalesce(rank, 99) <= 1)::INT), 6) AS recall_1, round(avg((coalesce(rank, 99) <= 3)::INT), 6) AS recall_3, round(avg((coalesce(rank, 99) <= 5)::INT), 6) AS recall_5, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, round(avg(coalesce(1.0::DOUBLE / log2(rank + 1.0), 0)), 6) AS ndcg FROM r")
def recall_mrr_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rank_metrics(metrics.first_relevant(_ranked(spark, sf), _gold(spark, sf)))


@query("hit_recall_rr", f"WITH {_BM25_SQL}, s AS (SELECT query, source, min(rank) AS rank FROM kw JOIN documents ON doc_id = doc WHERE rank <= 5 GROUP BY ALL), g AS (SELECT DISTINCT item_id AS query, source FROM benchmark JOIN documents ON doc_id % 40 = item_id AND lang = 'en'), m AS (SELECT g.query, count(*) AS w, count(rank) AS f, min(rank) AS first FROM g LEFT JOIN s USING (query, source) GROUP BY 1) SELECT query, (f > 0)::INT AS hit, round(f / w, 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr FROM m")
def hit_recall_rr(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "source", "lang")
    items = read(spark, sf, "benchmark").select(F.col("item_id").alias("query"))
    gold = docs.where("lang = 'en'").withColumn("query", F.col("doc") % 40).join(items, "query").select("query", "source").distinct()
    return metrics.group_metrics(_ranked(spark, sf).join(docs, "doc"), gold, "source", 5)


@query("range_relevance", f"WITH {_BM25_SQL}, top AS (SELECT query, doc, rank FROM kw WHERE rank <= 10), d AS (SELECT t.query, rank, source, n_chars // 2000 AS a, n_chars // 1500 AS b, text FROM top t JOIN documents ON doc_id = doc), q AS (SELECT item_id AS query, 'src' || (item_id % 20) AS source, 1 AS page, regexp_extract_all(text, '[A-Za-z]+')[1:3] AS terms FROM benchmark) SELECT q.query, min(rank) AS rank FROM q LEFT JOIN d ON d.query = q.query AND d.source = q.source AND page BETWEEN a AND b AND len([t FOR t IN terms IF contains(text, t)]) > 0 GROUP BY q.query")
def range_relevance(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("document"), F.floor(F.col("n_chars") / 2000).alias("page_start"), F.floor(F.col("n_chars") / 1500).alias("page_end"), "text")
    asked = read(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("document"), F.lit(1).alias("page"), F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, 3).alias("terms"))
    return metrics.range_relevant(_ranked(spark, sf).join(docs, "doc"), asked)


@query("latency_percentiles", "SELECT event_type, median(value) AS p50, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").groupBy("event_type").agg(F.median("value").alias("p50"), metrics.percentile("value", 0.95).alias("p95"), F.count(F.lit(1)).alias("n"))


_VALUE = "CASE WHEN l_linestatus = 'O' AND l_tax > 0.07 THEN NULL ELSE l_extendedprice END"


@query("weighted_mean_nullable", f"SELECT l_suppkey % 50 AS g, l_returnflag, round(CASE WHEN count(v) = count(*) THEN sum(v * l_quantity) / sum(l_quantity) END, 4) AS mean FROM (SELECT *, {_VALUE} AS v FROM lineitem) GROUP BY ALL")
def weighted_mean_nullable(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("g"), "l_returnflag", F.expr(_VALUE).alias("v"), "l_quantity")
    return rows.groupBy("g", "l_returnflag").agg(F.round(metrics.weighted_mean(F.col("v"), F.col("l_quantity")), 4).alias("mean"))


@query("nullable_sums", "SELECT l_shipdate::DATE AS day, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 4) AS returned, round(sum(l_quantity), 4) AS whole FROM lineitem GROUP BY 1")
def nullable_sums(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"), F.expr("CASE WHEN l_returnflag = 'R' THEN l_quantity END").alias("r"), "l_quantity")
    return rows.groupBy("day").agg(F.round(F.sum("r"), 4).alias("returned"), F.round(F.sum("l_quantity"), 4).alias("whole"))


@query("operational_metrics", "SELECT event_type, count(*) AS pages, round(avg((user_id % 7 <> 0)::INT), 6) AS success_rate, round(sum(value) / count(*), 6) AS seconds_per_page, sum((value * 100)::BIGINT)::BIGINT AS cost FROM events GROUP BY 1")
def operational_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "events").select("event_type", F.when(F.col("user_id") % 7 != 0, "success").otherwise("failed").alias("status"), F.col("value").alias("seconds"), F.round(F.col("value") * 100).cast("long").alias("cost"))
    return metrics.operational(rows, ["event_type"])


@query("metric_deltas", "WITH m AS (SELECT o_orderpriority AS experiment, round(avg(o_totalprice), 2) AS score, count(*) AS n FROM orders GROUP BY 1) SELECT m.experiment, round(m.score - b.score, 2) AS delta, m.n - b.n AS n_delta FROM m, m b WHERE b.experiment = '1-URGENT'")
def metric_deltas(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("experiment")).agg(F.round(F.avg("o_totalprice"), 2).alias("score"), F.count(F.lit(1)).alias("n"))
    base = rows.where("experiment = '1-URGENT'").select(F.col("score").alias("b"), F.col("n").alias("bn"))  # one row
    return rows.join(F.broadcast(base)).select("experiment", F.round(F.col("score") - F.col("b"), 2).alias("delta"), (F.col("n") - F.col("bn")).alias("n_delta"))


@query("citation_ownership", "SELECT l_orderkey AS answer, l_linenumber, CASE WHEN p_partkey IS NULL THEN 'unknown' WHEN p_size <> l_quantity::INT THEN 'cross_card' ELSE 'ok' END AS verdict FROM (SELECT *, l_partkey + (l_linenumber % 2) * 3 AS cited FROM lineitem) LEFT JOIN part ON p_partkey = cited")
def citation_ownership(spark: SparkSession, sf: str) -> DataFrame:
    cited = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("answer"), "l_linenumber", F.col("l_quantity").cast("int").alias("card"), (F.col("l_partkey") + F.col("l_linenumber") % 2 * 3).alias("evidence_id"))
    evidence = read(spark, sf, "part").select(F.col("p_partkey").alias("evidence_id"), F.col("p_size").alias("card"))
    return lineage.citations(cited, evidence).select("answer", "l_linenumber", "verdict")


@query("orphan_children", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def orphan_children(spark: SparkSession, sf: str) -> DataFrame:
    children = read(spark, sf, "embeddings").select("vec_id")
    return lineage.orphans(children, read(spark, sf, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id")


@query("graph_integrity", "WITH d AS (SELECT DISTINCT l_orderkey AS parent, l_linenumber AS child FROM lineitem WHERE l_quantity > 3), u AS (SELECT DISTINCT l_orderkey AS parent, l_linenumber AS child FROM lineitem WHERE l_discount < 0.1) SELECT parent, child, CASE WHEN d.parent IS NULL THEN 'down' ELSE 'up' END AS missing FROM (SELECT *, 1 AS x FROM d) d FULL JOIN (SELECT *, 1 AS y FROM u) u USING (parent, child) WHERE x IS NULL OR y IS NULL".replace("CASE WHEN d.parent IS NULL", "CASE WHEN x IS NULL"))
def graph_integrity(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem")
    edges = lambda c: rows.where(c).select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("child"))
    return lineage.edge_mismatches(edges("l_quantity > 3"), edges("l_discount < 0.1D"))


@query("set_equality", "SELECT o_custkey AS k, 'left' AS side FROM (SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT c_custkey, 'right' FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders)")
def set_equality(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return lineage.differences(a, read(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")))


@query("token_costs", "SELECT user_id, sum((round(value * 1000)::BIGINT * 2.5 * CASE WHEN value * 1000 > 50000 THEN 2 ELSE 1 END / 1000000)::DECIMAL(28, 10))::DOUBLE AS cost FROM events GROUP BY 1")
def token_costs(spark: SparkSession, sf: str) -> DataFrame:
    tokens = F.round(F.col("value") * 1000).cast("long")
    return read(spark, sf, "events").groupBy("user_id").agg(F.sum(metrics.token_cost(tokens, F.lit("2.5"), 50_000)).cast("double").alias("cost"))
