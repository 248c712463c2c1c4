"""Identity by content, and invariants as tables that must be empty."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(columns: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys and nulls."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"})


def digest(column: Column) -> Column:
    return F.sha2(column, 256)


def fingerprint(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """One row, ``fingerprint``: a tree of digests over the first four, then two, hexadecimal digits of the key's digest.

    A leaf digests its rows' digests in order of the key, a branch its leaves', the root its branches': 65,536 leaves, so a task
    holds a small part of the rows' digests.
    """
    of = lambda order: digest(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "d"))), lambda x: x["d"]), "")).alias("d")
    place = F.md5(F.col(key).cast("string"))
    own = rows.select(F.substring(place, 1, 4).alias("leaf"), F.col(key).cast("string").alias("k"), digest(content).alias("d"))
    leaves = own.groupBy("leaf").agg(of("k"))
    branches = leaves.groupBy(F.substring("leaf", 1, 2).alias("branch")).agg(of("leaf"))
    return branches.agg(of("branch").alias("fingerprint"))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is missing."""
    return children.join(parents.select(key), key, "left_anti")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def edge_mismatches(down: DataFrame, up: DataFrame) -> DataFrame:
    """(parent, child, missing) of edges told by one side alone; both are (parent, child)."""
    a = down.select("parent", "child").distinct().withColumn("_d", F.lit(1))
    b = up.select("parent", "child").distinct().withColumn("_u", F.lit(1))
    return a.join(b, ["parent", "child"], "full_outer").where("_d IS NULL OR _u IS NULL").select("parent", "child", F.when(F.col("_d").isNull(), "down").otherwise("up").alias("missing"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, with multiplicity; empty if they are the same."""
    side = F.lit
    return left.exceptAll(right).withColumn("side", side("left")).unionByName(right.exceptAll(left).withColumn("side", side("right")))


def citations(cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """cited (answer, card, evidence_id) with ``verdict``: ok, unknown, or another card's."""
    owned = evidence.select("evidence_id", F.col("card").alias("_owner"))
    joined = cited.join(owned, "evidence_id", "left")
    return joined.withColumn("verdict", F.when(F.col("_owner").isNull(), "unknown").when(F.col("_owner") != F.col("card"), "cross_card").otherwise("ok")).drop("_owner")


def require_empty(violations: DataFrame, what: str) -> None:
    """Raise with a sample row if there is a violation."""
    if (row := violations.limit(1).collect()):
        raise ValueError(f"{what}: {row[0].asDict()}")


@F.pandas_udf(T.BinaryType())
def packed_floats(vector: pd.Series) -> pd.Series:
    """Little-endian float32 bytes; an error for other than finite numbers."""

    def pack(v) -> bytes:
        x = np.asarray(v, "<f4")
        if not np.isfinite(x).all():
            raise ValueError("a vector isn't finite")
        return x.tobytes()

    return vector.map(pack)


def matrix_fingerprint(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """One row, ``fingerprint``, of the vectors' bytes in order of the key."""
    return fingerprint(rows, key, F.base64(packed_floats(vector)))


def chunk_freshness(parents: DataFrame, children: DataFrame, sources: DataFrame, contract: list[str]) -> DataFrame:
    """One row: whether stored chunks are those of their sources, and how many there are; both tables and sources are (document, contract columns).

    Current: every row agrees with its source in all contract columns (hashes, configurations, version), and both tables cover
    the sources' documents and no others.
    """
    rows = parents.select("document", *contract, F.lit("parent").alias("_kind")).unionByName(children.select("document", *contract, F.lit("child").alias("_kind")))
    own = sources.select(F.col("document").alias("_document"), *(F.col(c).alias(f"_{c}") for c in contract))
    met = rows.join(own, rows["document"] == own["_document"], "full_outer")
    agrees = F.col("_document").isNotNull()
    for c in contract:
        agrees &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    by_document = met.groupBy(F.coalesce("document", "_document").alias("document")).agg(F.count_if(F.col("_kind") == "parent").alias("p"), F.count_if(F.col("_kind") == "child").alias("c"), F.bool_and(agrees).alias("ok"))
    current = F.coalesce(F.bool_and(F.col("ok") & (F.col("p") > 0) & (F.col("c") > 0)), F.lit(False))
    p, c = F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))
    return by_document.agg(F.when(current, p).otherwise(0).alias("parents"), F.when(current, c).otherwise(0).alias("children"), (~current & (p + c > 0)).alias("stale"), p.alias("stored_parents"), c.alias("stored_children"))


def level_counts(chunks: DataFrame, level: str, problem: str) -> DataFrame:
    """(level, chunks, problems): chunks of each level, and those with a problem noted."""
    return chunks.groupBy(level).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col(problem).isNotNull()).alias("problems"))


def binding_violations(told: DataFrame, stored: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, problem) where what a manifest tells and what is stored aren't the same: 'missing', 'not told', or the name of a column that differs."""
    a = told.select(*keys, F.struct(*columns).alias("_a"))
    b = stored.select(*keys, F.struct(*columns).alias("_b"))
    met = a.join(b, keys, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    problems = [F.when(F.col("_b").isNull(), "missing"), F.when(F.col("_a").isNull(), "not told"), *(F.when(both & ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), c) for c in columns)]
    return met.select(*keys, F.explode(F.array_compact(F.array(*problems))).alias("problem"))
