"""Evaluation: ranks against gold, rates as ratios of sums, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_relevant(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(query, rank) for every query of gold (query, doc): the rank of the first relevant row, null if none."""
    hits = ranked.join(gold, ["query", "doc"]).groupBy("query").agg(F.min("rank").alias("rank"))
    return gold.select("query").distinct().join(hits, "query", "left")


def range_relevant(ranked: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, rank): the first row of the asked document whose page range holds the page and whose text holds any term.

    ranked: (query, document, page_start, page_end, text, rank); asked: (query, document, page, terms).
    """
    close = (F.col("r.query") == F.col("a.query")) & (F.col("r.document") == F.col("a.document")) & F.col("a.page").between(F.col("r.page_start"), F.col("r.page_end")) & F.exists("a.terms", lambda t: F.col("r.text").contains(t))
    hits = ranked.alias("r").join(asked.alias("a"), close).groupBy(F.col("a.query").alias("query")).agg(F.min("r.rank").alias("rank"))
    return asked.select("query").join(hits, "query", "left")


def rank_metrics(ranks: DataFrame, by: list[str] | None = None, at: tuple[int, ...] = (1, 3, 5), depth: int = 10, digits: int = 6) -> DataFrame:
    """n, recall_<k>, mrr and ndcg of (query, rank); nDCG with one relevant row."""
    r = F.col("rank")
    near = r <= depth
    mean = lambda x: F.round(F.avg(F.coalesce(x, F.lit(0.0))), digits)
    return ranks.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        *(mean(F.when(r <= k, 1.0)).alias(f"recall_{k}") for k in at),
        mean(F.when(near, 1.0 / r)).alias("mrr"),
        mean(F.when(near, 1.0 / F.log2(r + 1.0))).alias("ndcg"),
    )


def group_metrics(ranked: DataFrame, gold: DataFrame, group: str, k: int, digits: int = 6) -> DataFrame:
    """(query, hit, recall, rr): distinct groups of the first k rows against a query's gold groups (query, group)."""
    seen = ranked.where(F.col("rank") <= k).groupBy("query", group).agg(F.min("rank").alias("rank"))
    met = gold.join(seen, ["query", group], "left").groupBy("query").agg(F.count(F.lit(1)).alias("wanted"), F.count("rank").alias("found"), F.min("rank").alias("first"))
    return met.select("query", (F.col("found") > 0).cast("int").alias("hit"), F.round(F.col("found") / F.col("wanted"), digits).alias("recall"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), digits).alias("rr"))


def percentile(column: str, fraction: float) -> Column:
    """Nearest rank: a value that occurs."""
    return F.expr(f"percentile_disc({float(fraction)}D) WITHIN GROUP (ORDER BY `{column}`)")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Null if any value is."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.try_divide(F.sum(value * weight), F.sum(weight)))


def term_coverage(text: Column, terms: Column) -> Column:
    """Share of an array of terms that a text holds; null without terms."""
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: text.contains(t))) / F.size(terms))


def operational(pages: DataFrame, by: list[str]) -> DataFrame:
    """Rates of (by, status, expected, seconds, cost) page rows as ratios of sums."""
    done = F.count_if(F.col("status") == "success").cast("double")
    return pages.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pages"),
        F.round(F.try_divide(done, F.count(F.lit(1))), 6).alias("success_rate"),
        F.round(F.try_divide(F.sum("seconds"), F.count(F.lit(1))), 6).alias("seconds_per_page"),
        F.sum("cost").alias("cost"),
    )


def composite(text: Column, numeric_exact: Column, numeric_relation: Column, table_content: Column, table_structure: Column) -> Column:
    """Fixed weights of the parts of extraction quality."""
    return 0.40 * text + 0.20 * numeric_exact + 0.15 * numeric_relation + 0.125 * table_content + 0.125 * table_structure


def ordered_pairs(found: DataFrame, by: list[str], order: str, position: str) -> DataFrame:
    """(by, coverage, accuracy): share of items found, and share of pairs found in their order. Position null or negative: not found.

    Items of one document are a short list; its inversions are counted in one row.
    """
    items = found.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, position))), lambda x: x[position]).alias("p"))
    n = F.size("p")
    there = F.filter("p", lambda x: x >= 0)
    right = F.aggregate(F.transform(there, lambda x, i: F.size(F.filter(there, lambda y, j: (j > i) & (y > x)))), F.lit(0), lambda s, x: s + x)
    return items.select(*by, (F.size(there) / n).alias("coverage"), F.coalesce(F.try_divide(right.cast("double"), n * (n - 1) / 2), F.lit(1.0)).alias("accuracy"))


def token_cost(tokens: Column, price: Column, long_from: int | None = None, factor: float = 2.0) -> Column:
    """Price per million tokens, with a dearer rate for long contexts; exact decimals."""
    rate = price.cast("decimal(18,6)") * (F.when(tokens > long_from, F.lit(factor)).otherwise(F.lit(1.0)).cast("decimal(6,2)") if long_from else F.lit(1).cast("decimal(6,2)"))
    return (tokens.cast("decimal(18,0)") * rate / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(28,10)")


#: Characters around a number in which its context is looked for.
CONTEXT = 180


def numeric_labels(pages: DataFrame, labels: DataFrame, key: list[str], label: str, reach: int = CONTEXT) -> DataFrame:
    """(key, label, critical, found, in_context, exact, related) of labelled numbers: how often a page holds the number, how often with all context terms within reach, and whether that is as often as expected.

    pages: (key, text); labels: (key, label, surface, context array<string>, expected, critical). Blanks don't count.
    Occurrences may overlap; a label without a page has none.
    """
    dense = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    met = labels.join(pages.select(*key, dense(F.col("text")).alias("_text")), key, "left").withColumns({"_token": dense(F.col("surface")), "_terms": F.transform(F.coalesce("context", F.array().cast("array<string>")), dense)})
    # a look-ahead gives every start: what stands before it is as long as the text less what follows
    after = F.regexp_extract_all("_text", F.concat(F.lit("(?s)(?="), F.regexp_replace("_token", r"([^0-9A-Za-z가-힣])", r"\\$1"), F.lit("(.*))")), F.lit(1))
    starts = F.when(F.length("_token") > 0, F.transform(after, lambda rest: F.length("_text") - F.length(rest) - F.length("_token"))).otherwise(F.array().cast("array<int>"))
    around = F.transform("_starts", lambda p: F.substring(F.col("_text"), F.greatest(F.lit(0), p - reach) + 1, p + F.length("_token") + reach - F.greatest(F.lit(0), p - reach)))
    told = met.withColumn("_starts", F.coalesce(starts, F.array().cast("array<int>"))).withColumn("_with", F.filter(around, lambda w: F.forall(F.col("_terms"), lambda t: F.contains(w, t))))
    n, m = F.size("_starts"), F.size("_with")
    return told.select(*key, label, "critical", n.alias("found"), m.alias("in_context"), (n > 0).alias("exact"), (m == F.coalesce("expected", F.lit(1))).alias("related"))


def numeric_label_rates(scored: DataFrame) -> DataFrame:
    """One row: labels, the share found exactly, found in context, and of critical ones found; null without such labels."""
    share = lambda c, where=F.lit(True): F.avg(F.when(where, F.col(c).cast("double")))
    return scored.agg(F.count(F.lit(1)).alias("labels"), share("exact").alias("exact_rate"), share("related").alias("related_rate"), share("exact", F.col("critical")).alias("critical_rate"))
