"""Two extractions of the same documents held against each other: multisets, pairings, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Verdicts from mild to grave.
SEVERITY = ("pass", "review", "blocked")


def page_pairs(left: DataFrame, right: DataFrame, keys: tuple[str, ...], text: str = "text") -> DataFrame:
    """Pages of either lane: keys, left_text, right_text ('' where a lane lacks the page) and what is missing."""
    a = left.select(*keys, F.col(text).alias("left_text"))
    b = right.select(*keys, F.col(text).alias("right_text"))
    both = a.join(b, list(keys), "full_outer")
    return both.withColumns({"missing": F.when(F.col("left_text").isNull(), "left").when(F.col("right_text").isNull(), "right"), "left_text": F.coalesce("left_text", F.lit("")), "right_text": F.coalesce("right_text", F.lit(""))})


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def multiset_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_left, n_right, only_left, only_right, shared: one shuffle for both differences and the intersection."""
    sides = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    n = sides.groupBy(*keys).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))
    zero = F.lit(0).cast("long")
    return n.withColumns({"only_left": F.greatest(F.col("n_left") - F.col("n_right"), zero), "only_right": F.greatest(F.col("n_right") - F.col("n_left"), zero), "shared": F.least("n_left", "n_right")})


def multiset_scores(counts: DataFrame, by: list[str]) -> DataFrame:
    """precision, recall and f1 of (by, token, n_reference, n_candidate); both empty: 1."""
    sums = counts.groupBy(*by).agg(F.sum(F.least("n_reference", "n_candidate")).alias("overlap"), F.sum("n_candidate").alias("c"), F.sum("n_reference").alias("r"))
    none = (F.col("c") == 0) & (F.col("r") == 0)
    precision = F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(F.col("overlap").cast("double"), F.col("c")), F.lit(0.0)))
    recall = F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(F.col("overlap").cast("double"), F.col("r")), F.lit(0.0)))
    scored = sums.select(*by, precision.alias("precision"), recall.alias("recall"))
    return scored.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def exact_pairs(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, left_order, right_order): the k-th left row of a key with the k-th right one. Rows beyond a key's common count stay alone."""
    place = lambda name: F.row_number().over(W.partitionBy(*keys).orderBy(order)).alias(name)
    a = left.select(*keys, F.col(order).alias(f"left_{order}"), place("k"))
    b = right.select(*keys, F.col(order).alias(f"right_{order}"), place("k"))
    return a.join(b, [*keys, "k"]).drop("k")


def unique_pairs(left: DataFrame, right: DataFrame, within: list[str], key: str, anchor: str, order: str) -> DataFrame:
    """(within, left_order, right_order, match) of every row of both lanes.

    match: 'equal' by exact pairing on key; of the rest 'paired' where an anchor holds one row on each side,
    'ambiguous' where it holds several, 'unmatched' where the other lane has none.
    """
    equal = exact_pairs(left, right, [*within, key], order).select(*within, f"left_{order}", f"right_{order}", F.lit("equal").alias("match"))
    rest_l = left.join(equal.select(*within, F.col(f"left_{order}").alias(order)), [*within, order], "left_anti")
    rest_r = right.join(equal.select(*within, F.col(f"right_{order}").alias(order)), [*within, order], "left_anti")
    by = [*within, anchor]
    n_l = rest_l.groupBy(*by).agg(F.count(F.lit(1)).alias("nl"), F.min(order).alias("l"))
    n_r = rest_r.groupBy(*by).agg(F.count(F.lit(1)).alias("nr"), F.min(order).alias("r"))
    met = n_l.join(n_r, by, "full_outer")
    paired = met.where("nl = 1 AND nr = 1").select(*within, F.col("l").alias(f"left_{order}"), F.col("r").alias(f"right_{order}"), F.lit("paired").alias("match"))
    state = met.where("NOT (nl <=> 1 AND nr <=> 1)").select(*by, F.when(F.col("nl").isNull() | F.col("nr").isNull(), "unmatched").otherwise("ambiguous").alias("match"))
    null = F.lit(None).cast(left.schema[order].dataType)
    alone = rest_l.join(state, by).select(*within, F.col(order).alias(f"left_{order}"), null.alias(f"right_{order}"), "match")
    other = rest_r.join(state, by).select(*within, null.alias(f"left_{order}"), F.col(order).alias(f"right_{order}"), "match")
    return equal.unionByName(paired).unionByName(alone).unionByName(other)


def canonical(left: DataFrame, right: DataFrame, document: str, key: str) -> DataFrame:
    """(document, verdict, facts) for each document: 'canonical' if every key occurs once in each lane and in both, else 'review'."""
    counts = multiset_difference(left, right, [document, key])
    return counts.groupBy(document).agg(F.when(F.bool_and((F.col("n_left") == 1) & (F.col("n_right") == 1)), "canonical").otherwise("review").alias("verdict"), F.count(F.lit(1)).alias("facts"))


def duplicates(facts: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, duplicate_relations): rows beyond the first of each key."""
    n = facts.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by).agg(F.sum(F.col("n") - 1).alias("duplicate_relations"))


def severity(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITY)), level)


def worst(rows: DataFrame, by: list[str], level: str) -> DataFrame:
    """(by, verdict): the gravest level."""
    return rows.groupBy(*by).agg(F.max(severity(F.col(level))).cast("int").alias("s")).withColumn("verdict", F.element_at(F.array(*map(F.lit, SEVERITY)), F.col("s"))).drop("s")


def run_status(documents: DataFrame, by: list[str], level: str = "status") -> DataFrame:
    """(by, status): review before blocked before failed, else approved."""
    seen = documents.groupBy(*by).agg(F.collect_set(level).alias("seen"))
    has = lambda x: F.array_contains("seen", x)
    return seen.select(*by, F.when(has("review"), "review").when(has("blocked"), "blocked").when(has("failed"), "failed").otherwise("approved").alias("status"))


def page_issues(similarity: Column, f1: Column, has_numbers: Column, headings: Column, has_headings: Column, left_shapes: Column, right_shapes: Column, left_text: Column, right_text: Column, blank: Column, boxes: Column, uncertain: Column) -> Column:
    """Array of what is wrong with a page, in a fixed order."""
    told, other = F.trim(left_text) != "", F.trim(right_text) != ""
    rules = [
        ("blank_primary_nonempty_layout", blank & other),
        ("unexpected_empty_primary_page", ~blank & ~told),
        ("empty_layout_page", ~blank & ~other),
        ("text_similarity_low", told & other & (similarity < 0.45)),
        ("numeric_mismatch", has_numbers & (f1 < 0.75)),
        ("heading_alignment_low", has_headings & (headings < 0.6)),
        ("table_count_mismatch", F.size(left_shapes) != F.size(right_shapes)),
        ("table_structure_mismatch", (F.size(left_shapes) == F.size(right_shapes)) & (F.size(left_shapes) > 0) & (left_shapes != right_shapes)),
        ("bbox_coverage_low", boxes < 0.8),
        ("uncertain_primary_text", uncertain),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules)))


#: Fixed value: issues after which a page's structure is reviewed.
STRUCTURAL = ("table_count_mismatch", "table_structure_mismatch", "heading_alignment_low", "bbox_coverage_low", "blank_primary_nonempty_layout", "empty_layout_page")


def document_verdicts(pages: DataFrame, document: str = "document_id") -> DataFrame:
    """(document, pages, review_pages, verdict) of pages (document, issues)."""
    rough = F.size("issues") > 0
    return pages.groupBy(document).agg(F.count(F.lit(1)).alias("pages"), F.count_if(rough).alias("review_pages"), F.when(F.bool_or(rough), "review_required").otherwise("pass").alias("verdict"))


def group_statuses(pairs: DataFrame, keys: list[str], statuses: str = "statuses") -> DataFrame:
    """(keys, group, status) of paired facts' field statuses: difference before unresolved before pass."""
    from docloom.functions.amounts import GROUPS

    of = {f: g for g, fields in GROUPS.items() for f in fields}
    group = F.create_map(*(F.lit(x) for pair in of.items() for x in pair))
    rows = pairs.select(*keys, F.explode(statuses).alias("field", "status")).withColumn("group", group[F.col("field")]).where("group IS NOT NULL")
    worst = F.max(F.array_position(F.array(*map(F.lit, ("pass", "unresolved", "difference"))), F.col("status")).cast("int"))
    return rows.groupBy(*keys, "group").agg(worst.alias("w")).select(*keys, "group", F.element_at(F.array(*map(F.lit, ("pass", "unresolved", "difference"))), F.col("w")).alias("status"))


def group_counts(statuses: DataFrame) -> DataFrame:
    """A row for each group with the number of pairs of each status."""
    return statuses.groupBy("group").pivot("status", ["pass", "unresolved", "difference"]).count().na.fill(0)


def best_tables(labels: DataFrame, candidates: DataFrame, page: list[str], label: str) -> DataFrame:
    """(page, label, candidate, content, structure): the candidate table of a label's page with the best sum of both similarities, the first of equals.

    labels: (page, label, rows), candidates: (page, ordinal, rows); rows are arrays of arrays of strings. Labels without a candidate score 0.
    """
    from docloom.functions.measures import table_content, table_structure

    met = labels.select(*page, label, F.col("rows").alias("_want")).join(candidates.select(*page, "ordinal", F.col("rows").alias("_have")), page, "left")
    none = F.col("ordinal").isNull()
    scored = met.select(*page, label, "ordinal", F.when(none, 0.0).otherwise(table_content(F.col("_want"), F.col("_have"))).alias("content"), F.when(none, 0.0).otherwise(table_structure(F.col("_want"), F.col("_have"))).alias("structure"))
    best = F.max_by(F.struct("ordinal", "content", "structure"), F.struct((F.col("content") + F.col("structure")).alias("s"), -F.coalesce("ordinal", F.lit(0))))
    return scored.groupBy(*page, label).agg(best.alias("b")).select(*page, label, F.col("b.ordinal").alias("candidate"), "b.content", "b.structure")
