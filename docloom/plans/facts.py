"""Queries of facts: the driver's numbers written as Korean facts, then read back through literals, keys, typed columns and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import amounts, text
from docloom.operators import state, structured
from docloom.plans.catalogue import query, read

_TARGET = "CASE l_linenumber % 3 WHEN 0 THEN '커피' WHEN 1 THEN '주유' ELSE '편의점' END"


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """A line item as a fact: discount as a rate, quantity (in ten thousands) as the spending asked for, its number as the cap."""
    whole = lambda c: F.round(c).cast("int").cast("string")
    rows = read(spark, sf, "lineitem")
    told = {"benefit_type": F.lit("할인"), "action": F.lit("할인"), "target": F.expr(_TARGET), "value": whole(F.col("l_discount") * 100), "unit": F.lit("%"), "condition": F.concat(F.lit("전월 실적 "), whole(F.col("l_quantity")), F.lit("만원 이상")), "cap": F.concat(F.lit("월 "), F.col("l_linenumber").cast("string"), F.lit("만원"))}
    return rows.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("fact"), "l_returnflag", "l_quantity", "l_discount", *(told.get(f, F.lit("")).alias(f) for f in amounts.FIELDS))


def _typed(facts: DataFrame) -> DataFrame:
    literals = {"value": F.concat("value", "unit"), "condition": F.col("condition"), "cap": F.col("cap")}
    return facts.withColumns({f"{f}_literals": amounts.literals(c) for f, c in literals.items()})


@query("written_money", "SELECT l_orderkey, l_linenumber, 0 AS place, 'KRW' AS kind, (round(l_quantity)::BIGINT * 10000 + l_linenumber * 1000)::DOUBLE AS amount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 1, 'ratio', round(round(l_discount * 100) / 100, 6) FROM lineitem")
def written_money(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts in ten thousands and thousands, and rates, written out and read back."""
    told = F.concat(F.lit("월 "), F.round("l_quantity").cast("int").cast("string"), F.lit("만"), F.col("l_linenumber").cast("string"), F.lit("천원 또는 "), F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%"))
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode(amounts.literals(told)).alias("place", "x"))
    return rows.select("l_orderkey", "l_linenumber", "place", "x.kind", F.round(F.col("x.decimal").cast("double"), 6).alias("amount"))


@query("fact_relation_keys", "SELECT l_returnflag, count(*) AS facts, count(*) FILTER (WHERE l_returnflag <> 'R') AS equal FROM lineitem GROUP BY 1")
def fact_relation_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Each fact and the same in another spelling have one key; where the bound is another, they don't."""
    facts = _facts(spark, sf)
    bound = F.when(F.col("l_returnflag") == "R", "초과").otherwise("이상")
    won = lambda c: F.concat((F.round(c).cast("long") * 10_000).cast("string"), F.lit("원"))
    other = {"value": F.concat("value", F.lit(".0%")), "unit": F.lit("퍼센트"), "condition": F.concat(won(F.col("l_quantity")), F.lit(" "), bound, F.lit(" 전월 실적")), "cap": F.concat(F.lit("월 최대 "), won(F.col("fact"))), "action": F.lit("할인입니다")}
    spelt: Column = F.struct(*(other.get(f, F.col(f)).alias(f) for f in amounts.FIELDS))
    # facts of one wording have one key: it is made once for each
    told = facts.select("l_returnflag", F.struct(*amounts.FIELDS).alias("a"), spelt.alias("b")).groupBy("l_returnflag", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    keys = told.select("l_returnflag", "n", amounts.relation_key(F.col("a")).alias("a"), amounts.relation_key(F.col("b")).alias("b"))
    return keys.groupBy("l_returnflag").agg(F.sum("n").alias("facts"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0).cast("long")).alias("equal"))


@query("fact_errors", "SELECT CASE WHEN l_linenumber = 1 THEN 'required field missing' WHEN l_linenumber = 2 THEN 'blank value' WHEN l_linenumber = 3 THEN 'malformed amount' WHEN l_linenumber = 4 THEN 'incompatible dimensions' END AS error, count(*) AS facts FROM lineitem GROUP BY 1")
def fact_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Facts spoilt by their number: without a target, with a dash, with an amount that is none, with a unit of another kind."""
    n = F.col("fact")
    spoilt = {"target": F.when(n != 1, F.col("target")).otherwise(""), "value": F.when(n == 2, "-").when(n == 4, F.concat("value", F.lit("%"))).otherwise(F.col("value")), "unit": F.when(n == 4, "원").otherwise(F.col("unit")), "cap": F.when(n == 3, "월 1만2억원").otherwise(F.col("cap"))}
    fact = F.struct(*(spoilt.get(f, F.col(f)).alias(f) for f in amounts.FIELDS))
    # facts of one wording have one error: it is looked for once for each
    told = _facts(spark, sf).select(fact.alias("fact")).groupBy("fact").agg(F.count(F.lit(1)).alias("n"))
    return told.select("n", amounts.fact_error(F.col("fact")).alias("error")).groupBy("error").agg(F.sum("n").alias("facts"))


@query("typed_columns", "SELECT l_orderkey AS document_id, l_linenumber AS fact, round(round(l_discount * 100), 6) AS percent, (round(l_quantity) * 10000)::BIGINT AS spend, (l_linenumber * 10000)::BIGINT AS cap FROM lineitem")
def typed_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Rates, spending and caps as columns with a state of their own."""
    percent, spend, cap = structured.percent_column(F.col("value"), F.col("unit"), F.col("value_literals")), structured.spend_column(F.col("condition"), F.col("condition_literals")), structured.cap_column(F.col("cap"), F.col("cap_literals"))
    fields = ["value", "unit", "condition", "cap"]
    typed = lambda w: _typed(w).select(*fields, F.round(percent["value"], 6).alias("percent"), spend["value"].alias("spend"), cap["value"].alias("cap_krw"))
    return structured.by_wording(_facts(spark, sf), fields, typed).select("document_id", "fact", "percent", "spend", F.col("cap_krw").alias("cap"))


@query(
    "facts_by_requirement",
    f"""WITH f AS (SELECT l_orderkey AS document_id, {_TARGET} AS target, round(l_discount * 100) AS pct, round(l_quantity) * 10000 AS spend, l_linenumber * 10000 AS cap FROM lineitem)
    SELECT DISTINCT document_id FROM f a WHERE (EXISTS (SELECT 1 FROM f x WHERE x.document_id = a.document_id AND target = '커피' AND pct >= 5) AND EXISTS (SELECT 1 FROM f x WHERE x.document_id = a.document_id AND target = '주유' AND pct >= 3 AND cap >= 40000))
    OR EXISTS (SELECT 1 FROM f x WHERE x.document_id = a.document_id AND target = '편의점' AND spend <= 100000)""",
)
def facts_by_requirement(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that meet one of two groups of requirements, through the typed columns."""
    need = structured.Requirement
    plan = structured.Plan(((need(("커피",), "discount", min_percent=5), need(("주유",), "discount", min_percent=3, min_cap_krw=40_000)), (need(("편의점",), "discount", max_spend_krw=100_000),)))
    return structured.select_documents(_typed(_facts(spark, sf)), plan)


@query("amount_aliases", "SELECT p_partkey, unnest(['money_krw_' || (p_size * 10000 + 5000)::BIGINT, 'money_krw_' || round(p_retailprice)::BIGINT, 'percent_' || p_size || '.5', 'period_월_' || (p_size % 7 + 1) || '_회']) AS term FROM part")
def amount_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Aliases of written amounts, rates and periods among the search tokens."""
    size = F.col("p_size").cast("string")
    told = F.concat(size, F.lit("만 5천원 "), F.round("p_retailprice").cast("long").cast("string"), F.lit("원, "), size, F.lit(".50 % 할인 월 "), (F.col("p_size") % 7 + 1).cast("string"), F.lit("회"))
    rows = read(spark, sf, "part").select("p_partkey", F.explode(text.search_tokens(told)).alias("term"))
    return rows.where(F.col("term").rlike("^(?:money|percent|period)_"))


@query("embedding_coverage", "SELECT count(*) AS total, count(*) FILTER (WHERE label % 3 = 1 AND vec_id % 4 <> 0) AS embedded, list_sort(list(DISTINCT len(embedding)) FILTER (WHERE label % 3 = 1 AND vec_id % 4 <> 0))[1] AS dimension FROM embeddings")
def embedding_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "embeddings").select(F.when(F.col("vec_id") % 4 != 0, F.col("embedding")).alias("embedding"), F.when(F.col("label") % 3 == 1, "own").otherwise("other").alias("embedding_model"))
    return state.embedding_status(rows, "own").select("total", "embedded", F.get("dimensions", F.lit(0)).cast("long").alias("dimension"))


@query("next_cases", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber AND b.l_returnflag = 'R')) WHERE n <= 2")
def next_cases(spark: SparkSession, sf: str) -> DataFrame:
    cases = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return state.next_cases(cases, cases.where("l_returnflag = 'R'"), ["l_orderkey"], "l_linenumber", "l_linenumber", 2).select("l_orderkey", "l_linenumber")


@query(
    "stage_barrier",
    """WITH s AS (SELECT unnest([1, 2, 3]) AS i), t AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), d AS (SELECT l_orderkey, l_linenumber, max(CASE WHEN l_quantity > 40 THEN 1 WHEN l_returnflag = 'R' THEN 2 ELSE 3 END) AS upto FROM lineitem GROUP BY ALL),
    o AS (SELECT t.l_orderkey, min(CASE WHEN d.upto < s.i THEN s.i END) AS first FROM t CROSS JOIN s JOIN d USING (l_orderkey, l_linenumber) GROUP BY 1)
    SELECT l_orderkey, coalesce(first - 1, 3)::INT AS n_completed, CASE first WHEN 1 THEN 'structure' WHEN 2 THEN 'validate' END AS stopped_before FROM o""",
)
def stage_barrier(spark: SparkSession, sf: str) -> DataFrame:
    stages = ["extract", "structure", "validate"]
    done = F.when(F.col("l_quantity") > 40, 1).when(F.col("l_returnflag") == "R", 2).otherwise(3)
    rows = read(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("item"), F.explode(F.slice(F.array(*map(F.lit, stages)), F.lit(1), done)).alias("stage"), F.lit("done").alias("status"))
    return state.stage_barrier(rows, ["l_orderkey"], stages).select("l_orderkey", F.size("completed").alias("n_completed"), "stopped_before")
