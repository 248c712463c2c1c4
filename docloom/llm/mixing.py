"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each source gets a word target; complete epochs of the source come first, and what is left of the
target is filled by documents in the order of exponential keys -ln(u)/w (u: a uniform number from
a digest of the id, so reruns agree; w: the document's quality weight), summed up to the budget.

Prefix sums within a source don't put the source into one task: keys are first summed by narrow
key bins (bins grow with the source's rows), bins are summed in order, and only the bin in which a source's
budget ends is ordered row by row. Bins are cut by the keys' expected distribution function, which is that of
a mixture: the rows of each level of weight have exponential keys of that rate. So bins are even
whatever the weights are.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; an empty
table gives no rows; repeated rows are separate documents, drawn one by one; sources whose
documents have no words have target 0. Extra columns of the input are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docloom.llm.common import JAVA_WORD, row_keyed, set_aside, staged

#: A source's target is at most so many times its size.
MOST_EPOCHS = 3
#: Rows a key bin holds on average.
BIN_ROWS = 1024
#: Levels of weight in a doubling.
LEVELS = 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(JAVA_WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for text without markup noise, falling with the share of the characters #$%&*|!."""
    noise = F.regexp_count(text, F.lit("[#$%&*|!]")).cast("double")
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.lit(20.0) * noise / F.greatest(F.length(text), F.lit(1))), F.lit(1.0))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], total_share: float = 1.0, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """One row for each source: its size and word target.

    The targets are min(most_epochs * size, level * weight) with one level for all sources such that
    they sum to the total: what resharing the excess by weight, again and again, ends in. The level
    is found by one pass over the sources in the order of the level at which each is full.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sizes.withColumn("weight", F.get(weight, (F.row_number().over(by_name) - 1) % len(weights))).withColumn("cap", F.lit(float(most_epochs)) * F.col("source_size"))
    full = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = full.rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    levels = ranked.select(
        "*",
        (F.lit(float(total_share)) * F.sum("source_size").over(whole)).alias("total"),
        ((F.lit(float(total_share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"),
    )
    # the level at the first source that it doesn't fill; every source before that one is full
    fitting = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "level"))).over(whole)
    return levels.withColumn("held", fitting["level"]).select("source", "source_size", "n_docs", *(c for c in sizes.columns if c == "rates"), F.when(F.col("source_size") == 0, 0.0).otherwise(F.coalesce(F.least(F.col("cap"), F.col("held") * F.col("weight")), F.col("cap"))).alias("target"))


def rates(rows: DataFrame) -> DataFrame:
    """(source, source_size, n_docs, rates) of (source, size, weight): rates holds (n, rate) of each level of weight, in order."""
    level = F.floor(F.log2("weight") * LEVELS)
    levels = rows.groupBy("source", level.alias("level")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max("weight").alias("rate"))  # no mean, which would depend on the order of rows
    return levels.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n_docs"), F.array_sort(F.collect_list(F.struct("rate", "n"))).alias("rates"))


def key_bin() -> Column:
    """The number of a row's key bin: the expected number of its source's rows of smaller keys, by BIN_ROWS. It never falls as the key rises."""
    before = F.aggregate("rates", F.lit(0.0), lambda s, x: s + x["n"] * (1 - F.exp(-x["rate"] * F.col("key"))))
    return F.least(F.floor(before / F.col("n_docs") * F.col("bins")), F.col("bins") - 1).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), id_col: str = "doc_id", seed: int = 17) -> DataFrame:
    """(doc_id, size, source, source_size, target, epochs, copies, taken) for every document of (doc_id, text, source)."""
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(str(seed)))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), word_count(F.col("text")).alias("size"), F.col("source").cast("string").alias("source"), quality_weight(F.col("text")).alias("weight"), (-F.log(u) / quality_weight(F.col("text"))).alias("key")), "mix")
    sums = rates(rows)
    targets = source_targets(sums, weights).withColumns({"epochs": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)}).withColumns({"rest": F.col("target") - F.col("epochs") * F.col("source_size"), "bins": F.ceil(F.col("n_docs") / BIN_ROWS)})
    binned = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).select(rows["*"], "source_size", "target", "epochs", "rest", key_bin().alias("bin"))
    in_bins = binned.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.first("rest").alias("rest"))
    before = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = in_bins.withColumn("ahead", F.coalesce(F.sum("bin_size").over(before), F.lit(0))).select(F.col("source").alias("s"), F.col("bin").alias("b"), "ahead", (F.col("ahead") + F.col("bin_size")).alias("until"))
    placed = binned.join(bins, binned["source"].eqNullSafe(bins["s"]) & (binned["bin"] == bins["b"]))
    open_bin = (F.col("ahead") < F.col("rest")) & (F.col("until") > F.col("rest"))
    settled = placed.where(~open_bin).withColumn("drawn", (F.col("until") <= F.col("rest")).cast("long"))
    order = W.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    ahead = F.col("ahead") + F.coalesce(F.sum("size").over(order), F.lit(0))
    # the document on which the budget ends is drawn if that ends nearer to the budget
    last = placed.where(open_bin).withColumn("drawn", (ahead + F.col("size") / 2 <= F.col("rest")).cast("long"))
    copies = F.col("epochs") + F.col("drawn")
    return settled.unionByName(last).select("doc_id", "size", "source", "source_size", "target", "epochs", copies.cast("long").alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), id_col: str = "doc_id", seed: int = 17) -> DataFrame:
    """docs as the mix takes them: each row as often as it is drawn, rows not drawn left out."""
    docs, restored = set_aside(docs, "row_key", "copies", "_copy")
    keyed = row_keyed(docs, id_col)
    drawn = mix(keyed.select("row_key", "text", "source"), weights, "row_key", seed).where("copies > 0").select(F.col("doc_id").alias("row_key"), "copies")
    return restored(keyed.join(drawn.hint("merge"), "row_key").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(docs.columns))
