"""Queries of structured filters. Orders stand for documents, their line items for facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import structured
from docloom.plans.catalogue import query, read


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), "l_linenumber", "l_discount", "l_quantity", "l_tax", "l_returnflag", "l_shipdate")


CHEAP = "l_discount >= 0.05D AND l_quantity <= 20"
RETURNED = "l_returnflag = 'R' AND l_tax < 0.03D"
LARGE = "l_quantity >= 45"


@query("structured_and", "SELECT l_orderkey AS document_id FROM lineitem GROUP BY 1 HAVING bool_or(l_discount >= 0.05 AND l_quantity <= 20) AND bool_or(l_returnflag = 'R' AND l_tax < 0.03)")
def structured_and(spark: SparkSession, sf: str) -> DataFrame:
    return structured.divided(_facts(spark, sf), "document_id", [[F.expr(CHEAP), F.expr(RETURNED)]])


@query("structured_or_groups", "SELECT l_orderkey AS document_id FROM lineitem GROUP BY 1 HAVING (bool_or(l_discount >= 0.05 AND l_quantity <= 20) AND bool_or(l_returnflag = 'R' AND l_tax < 0.03)) OR (bool_or(l_quantity >= 45) AND bool_or(l_returnflag = 'R' AND l_tax < 0.03))")
def structured_or_groups(spark: SparkSession, sf: str) -> DataFrame:
    return structured.divided(_facts(spark, sf), "document_id", [[F.expr(CHEAP), F.expr(RETURNED)], [F.expr(LARGE), F.expr(RETURNED)]])


_LADDER = """CASE WHEN l_returnflag = 'N' THEN 'false' WHEN l_linestatus IS NULL THEN 'unknown' WHEN l_discount < 0.03 THEN 'false' WHEN l_quantity > 40 THEN 'false' WHEN l_tax = 0 THEN 'unknown' ELSE 'true' END"""


@query("structured_tristate", f"SELECT {_LADDER} AS status, count(*) AS facts, count(DISTINCT l_orderkey) AS documents FROM lineitem GROUP BY 1")
def structured_tristate(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem")
    status = structured.three_valued(("false", F.expr("l_returnflag = 'N'")), ("unknown", F.expr("l_linestatus IS NULL")), ("false", F.expr("l_discount < 0.03D")), ("false", F.expr("l_quantity > 40")), ("unknown", F.expr("l_tax = 0")))
    return rows.select(status.alias("status"), "l_orderkey").groupBy("status").agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("l_orderkey").alias("documents"))


@query(
    "structured_fallback",
    "WITH base AS (SELECT o_orderpriority AS g, o_orderkey AS k FROM orders WHERE o_orderdate < DATE '1996-01-01'), m AS (SELECT DISTINCT g, k FROM base JOIN lineitem ON l_orderkey = k WHERE l_quantity >= 49 AND g LIKE '%-%' AND g < '3') SELECT * FROM m UNION ALL SELECT * FROM base WHERE g NOT IN (SELECT g FROM m)",
)
def structured_fallback(spark: SparkSession, sf: str) -> DataFrame:
    base = read(spark, sf, "orders").where("o_orderdate < TIMESTAMP_NTZ'1996-01-01'").select(F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("k"))
    facts = _facts(spark, sf).where("l_quantity >= 49").select(F.col("document_id").alias("k"))
    return structured.with_fallback(base.where("g LIKE '%-%' AND g < '3'").join(facts, "k", "left_semi").select("g", "k"), base, "g")


_GROUPS = {"tool": ["bolt", "gear", "widget"], "small": ["small", "tiny"]}


@query("alias_expand_match", "WITH a AS (SELECT * FROM (VALUES ('tool', 'bolt'), ('tool', 'gear'), ('tool', 'widget'), ('small', 'small'), ('small', 'tiny')) v(g, alias)) SELECT g AS alias_group, p_partkey, count(*) AS hits FROM part JOIN a ON contains(replace(lower(p_name || p_type), ' ', ''), alias) GROUP BY ALL")
def alias_expand_match(spark: SparkSession, sf: str) -> DataFrame:
    """Alias groups are a fixed list of words; each part is met with the words it holds."""
    parts = read(spark, sf, "part").select("p_partkey", F.regexp_replace(F.lower(F.concat("p_name", "p_type")), " ", "").alias("t"))
    pairs = F.array(*(F.struct(F.lit(g).alias("g"), F.lit(a).alias("a")) for g, its in _GROUPS.items() for a in its))
    hits = parts.select("p_partkey", F.explode(F.filter(pairs, lambda x: F.col("t").contains(x["a"]))).alias("x"))
    return hits.groupBy(F.col("x.g").alias("alias_group"), "p_partkey").agg(F.count(F.lit(1)).alias("hits"))


@query("exclude_targets", "SELECT p_partkey, p_name, p_type FROM part WHERE contains(p_name, 'small') AND NOT contains(p_name, 'ring') AND NOT contains(lower(p_type), 'promo')")
def exclude_targets(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "part").withColumns({"named": structured.named_text(F.col("p_name")), "kind": structured.named_text(F.col("p_type"))})
    return rows.where(structured.mentions(F.col("named"), "small") & ~structured.mentions(F.col("named"), "ring") & ~structured.mentions(F.col("kind"), "promo")).select("p_partkey", "p_name", "p_type")


@query(
    "explicit_scope_longest_match",
    """WITH q AS (SELECT doc_id AS query, replace(replace(replace(lower(text), ' ', ''), chr(10), ''), chr(9), '') AS t FROM documents),
    n AS (SELECT DISTINCT lower(regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+')) AS name, item_id AS key FROM benchmark),
    f AS (SELECT replace(name, ' ', '') AS form, count(DISTINCT key) AS keys, min(key) AS key FROM n WHERE length(replace(name, ' ', '')) >= 4 GROUP BY 1),
    hit AS (SELECT query, form, keys, key, t FROM q JOIN f ON contains(t, form)),
    x AS (SELECT a.query, a.form, a.keys, a.key, a.t, list(b.form ORDER BY length(b.form) DESC) FILTER (WHERE b.form IS NOT NULL) AS longer FROM hit a LEFT JOIN hit b ON a.query = b.query AND length(b.form) > length(a.form) AND contains(b.form, a.form) GROUP BY ALL),
    k AS (SELECT * FROM x WHERE longer IS NULL OR contains(list_reduce(list_prepend(t, longer), lambda s, w: replace(s, w, chr(1))), form))
    SELECT DISTINCT query, key FROM k WHERE query NOT IN (SELECT query FROM k WHERE keys > 1)""",
)
def explicit_scope_longest_match(spark: SparkSession, sf: str) -> DataFrame:
    asked = read(spark, sf, "documents").select(F.col("doc_id").alias("query"), "text")
    names = read(spark, sf, "benchmark").select(F.col("item_id").alias("key"), F.regexp_extract("text", "^[A-Za-z]+ [A-Za-z]+", 0).alias("name"))
    return structured.explicit_scope(asked, names)


@query("query_classify", "SELECT conv_id, turn, CASE WHEN regexp_matches(t, '^(?:the|le|la|der) ') THEN 'proper_noun' WHEN regexp_matches(t, '(?:^| )(?:un|une|ein|a)(?: |$)') THEN 'numeric_condition' ELSE 'semantic' END AS query_class FROM (SELECT *, regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '[ ?.!,。？！]+$', '') AS t FROM conversations WHERE role = 'user')")
def query_classify(spark: SparkSession, sf: str) -> DataFrame:
    """The driver's texts ask in invented words: articles stand for the endings that tell the classes."""
    rows = read(spark, sf, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", text.query_class(text.single_spaced(F.lower("text")), "^(?:the|le|la|der) ", "(?:^| )(?:un|une|ein|a)(?: |$)").alias("query_class"))


@query("complement_scope", "SELECT o_custkey AS owner, c.n_name AS card FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') CROSS JOIN (SELECT n_name FROM nation) c WHERE NOT EXISTS (SELECT 1 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = o_custkey AND n_name = c.n_name)")
def complement_scope(spark: SparkSession, sf: str) -> DataFrame:
    """For each owner the catalogue (a fixed list, one array) less what is owned."""
    owners = read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("owner")).distinct()
    names = read(spark, sf, "nation")
    owned = read(spark, sf, "customer").join(names, F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("c_custkey").alias("owner")).agg(F.collect_set("n_name").alias("owned"))
    whole = names.agg(F.collect_set("n_name").alias("cards"))
    kept = owners.join(owned, "owner", "left").join(F.broadcast(whole))
    return kept.select("owner", F.explode(F.array_except("cards", F.coalesce("owned", F.array().cast("array<string>")))).alias("card"))
