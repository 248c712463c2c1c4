"""Line dedup in DataFrame operations only: a suffix array over line numbers by distributed prefix doubling.

Lines that occur once can't be part of a repeated run, so only repeated lines take part. Each distinct
one gets an order-preserving number; a suffix is a place in a document's sequence of lines. Step by
step, suffixes are ranked by their first 1, 2, 4, ... lines: the rank for 2k lines is that of the pair
(rank for k lines here, rank for k lines k places on). Pairs are ranked by a range-partitioned sort, so
no task holds all suffixes or those of one hot line. Suffixes of equal rank are an interval of the
suffix array whose longest common prefix has that many lines at least; suffixes alone in their interval
are settled and drop out, and doubling ends when none is left.

The exact longest common prefix of a suffix with any earlier one follows from the intervals in halving
steps: a suffix that is not the first of its interval of 2k lines but of that of 4k tries k lines more
against the interval's members, then k/2, and so on. Of each interval only its first member is
carried beside the suffixes that are still trying, so a step holds no more rows than twice these.

A maximal repeated run begins where a suffix shares more with an earlier place than the tail of
what the suffix before it shares. Runs of ``min_lines`` lines or more, and single lines of ``min_words`` words
or more, are deleted where they aren't the first of their kind in (document, line) order. Runs copied from
different places may overlap: A B of one document and B C of another, met as A B C, are two runs, and
all three lines go, since each lies in a later copy of a run. The first occurrence of a line is never deleted.

Defined cases: a null or empty text stays as it is and has no lines; blank lines are kept, belong to no
run and don't break one; repeated ids are separate rows, in the order of their row keys; extra
columns are kept, save those named like the output's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docloom.llm.common import JAVA_WORD, dropped, passing, row_keyed, set_aside, staged

#: Runs of so many lines, and single lines of so many words, are deleted where they are repeated.
MIN_LINES, MIN_WORDS = 2, 50
#: Suffixes of one interval that a task joins with what is known of the interval; more are dealt to several.
SALT_ROWS = 512


def ranked(keys: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Distinct keys (columns, n, ...) with ``rank``: how many rows the keys before hold, plus 1. Sorted by range; partitions are numbered before the sums."""
    cut = staged(keys.repartitionByRange(*columns).withColumn("pid", F.spark_partition_id()), name)
    before = W.partitionBy("pid").orderBy(*columns).rowsBetween(W.unboundedPreceding, -1)
    ahead = W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    starts = cut.groupBy("pid").agg(F.sum("n").alias("size")).select("pid", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("start"))
    return cut.withColumn("own", F.coalesce(F.sum("n").over(before), F.lit(0))).join(starts, "pid").withColumn("rank", F.col("own") + F.col("start") + 1).drop("own", "start", "pid")


def all_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(row_key, line_no, place, h, c, k, wide) of the lines of (row_key, text) that aren't blank: place counts them in their document; h, c, k are hash, checksum and length; wide: of ``min_words`` words or more."""
    numbered = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("line_no"), line.alias("line")))
    kept = F.filter(numbered, lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))
    lines = docs.where(F.length("text") > 0).select("row_key", F.posexplode(kept).alias("place", "x"))
    # so many words need twice as many characters, less one: shorter lines aren't searched
    wide = F.when(F.length("x.line") >= 2 * min_words - 1, F.regexp_count("x.line", F.lit(JAVA_WORD)) >= min_words).otherwise(False)
    return lines.select("row_key", "place", F.col("x.line_no").alias("line_no"), F.xxhash64("x.line").alias("h"), F.crc32(F.encode("x.line", "UTF-8")).alias("c"), F.length("x.line").alias("k"), wide.alias("wide"))


def at(key: str = "row_key", place: str = "place") -> Column:
    return F.struct(F.col(key).alias("row_key"), F.col(place).alias("place"))


def salt(members: str) -> Column:
    """The part of its interval that a suffix is dealt to, for an interval of so many members."""
    return F.pmod(F.xxhash64("row_key", "place"), F.ceil(F.col(members) / SALT_ROWS))


def salts(members: str) -> Column:
    """All parts of an interval."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(members) / SALT_ROWS) - 1))


def suffix_intervals(docs: DataFrame, min_words: int = MIN_WORDS) -> list[tuple[int, DataFrame]]:
    """For each depth reached, (row_key, place, line_no, wide, rank, n, first): suffixes that share ``depth`` lines with others have one rank, their number n > 1 and their first member. Doubling goes on until no suffix shares more."""
    spark = docs.sparkSession
    columns = ("row_key", "place", "line_no", "wide", "rank", "n", "first")
    with passing(spark) as stays:
        keyed = staged(all_lines(docs, min_words), "lines")
        counts = keyed.groupBy("h", "c", "k").agg(F.count(F.lit(1)).alias("n"), F.min(at()).alias("first")).where("n > 1")
        numbers = ranked(counts, ["h", "c", "k"], "numbers")
        now = stays(staged(keyed.join(numbers, ["h", "c", "k"]).select(*columns), "suffixes"))
    out, depth = [], 1
    while not now.isEmpty():
        out.append((depth, now))
        here = W.partitionBy("row_key").orderBy("place").rangeBetween(depth, depth)
        pairs = now.withColumn("r2", F.first("rank").over(here)).where("r2 IS NOT NULL").select("row_key", "place", "line_no", "wide", F.col("rank").alias("r1"), "r2", F.col("n").alias("n1"), salt("n").alias("salt"))
        with passing(spark) as stays:
            pairs = staged(pairs, "pairs")
            same = pairs.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n"), F.min(at()).alias("first"), F.max("n1").alias("n1")).where("n > 1")
            known = ranked(same, ["r1", "r2"], "ranks").withColumn("salt", salts("n1")).drop("n1")
            now = stays(staged(pairs.join(known, ["r1", "r2", "salt"]).select(*columns), "suffixes"))
        depth *= 2
    return out


def shared_lengths(intervals: list[tuple[int, DataFrame]]) -> DataFrame:
    """(row_key, place, len, source): for every suffix that shares lines with an earlier one, how many it shares at most, and the first place that holds so many."""
    depth, lines = intervals[0]
    single = lines.where(F.col("first") != at()).select("row_key", "place", F.lit(1).cast("long").alias("len"), F.col("first").alias("source"))
    known: DataFrame | None = None  # suffixes that share two lines or more
    for i in range(len(intervals) - 1, -1, -1):
        depth, table = intervals[i]
        last = known
        with passing(table.sparkSession) as stays:
            if known is not None:
                known = _tried(known, depth, table)
            if i:
                own = table.where(F.col("first") != at())
                if i + 1 < len(intervals):  # those that share twice as many lines are known
                    deeper = intervals[i + 1][1]
                    own = own.join(deeper.where(F.col("first") != at()).select("row_key", "place").hint("merge"), ["row_key", "place"], "left_anti")
                own = own.select("row_key", "place", F.lit(depth).cast("long").alias("len"), F.col("first").alias("source"), F.col("n").alias("m"))
                known = own if known is None else known.unionByName(own)
            if known is not None:
                known = stays(staged(known, "shared"))
        if last is not None:
            dropped(last)
    if known is None:
        return single
    return single.join(known.select("row_key", "place").hint("merge"), ["row_key", "place"], "left_anti").unionByName(known.drop("m"))


def _tried(known: DataFrame, more: int, table: DataFrame) -> DataFrame:
    """known (row_key, place, len, source, m) with ``more`` lines added where an earlier member of the interval (len, source) shares these too; m: the interval's members, or more."""
    interval = ["len", "source"]
    firsts = known.groupBy(*interval).agg(F.max("m").alias("m")).select(F.col("source.row_key").alias("row_key"), F.col("source.place").alias("place"), *interval, "m")
    further = table.select("row_key", F.col("place").cast("long").alias("next"), "rank").hint("merge")
    tried = known.unionByName(firsts).withColumn("next", F.col("place") + F.col("len")).join(further, ["row_key", "next"], "left")
    tried = staged(tried.select("row_key", "place", *interval, "m", "rank", salt("m").alias("salt")), "tried")
    found = tried.where("rank IS NOT NULL").groupBy(*interval, "rank").agg(F.count(F.lit(1)).alias("n"), F.min(at()).alias("best"), F.max("m").alias("bound")).where("n > 1")
    found = found.withColumn("salt", salts("bound")).drop("bound").hint("merge")
    longer = F.col("best").isNotNull() & (F.col("best") != at())
    return (
        tried.where(F.col("source") != at())
        .join(found, [*interval, "rank", "salt"], "left")
        .select("row_key", "place", F.when(longer, F.col("len") + more).otherwise(F.col("len")).alias("len"), F.when(longer, F.col("best")).otherwise(F.col("source")).alias("source"), F.when(longer, F.col("n")).otherwise(F.col("m")).alias("m"))
    )


def copied_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(row_key, place, line_no, len, source, opens) of lines in a later copy of a run: opens where a run begins, of ``len`` lines and first found at ``source``."""
    intervals = suffix_intervals(docs, min_words)
    if not intervals:
        return docs.sparkSession.createDataFrame([], "row_key long, place int, line_no int, len long, source struct<row_key:long,place:int>, opens boolean")
    lines = intervals[0][1].select("row_key", "place", "line_no", "wide")
    known = lines.join(shared_lengths(intervals).hint("merge"), ["row_key", "place"], "left")
    in_order = W.partitionBy("row_key").orderBy("place")
    tail = F.when(F.lag("place").over(in_order) == F.col("place") - 1, F.lag("len").over(in_order) - 1)
    long = F.col("len") >= min_lines
    reach = F.max(F.when(long, F.col("place") + F.col("len"))).over(in_order.rowsBetween(W.unboundedPreceding, 0))
    known = known.withColumns({"tail": F.coalesce(tail, F.lit(0)), "covered": F.coalesce(reach > F.col("place"), F.lit(False))})
    alone = ~F.col("covered") & F.col("wide") & F.col("len").isNotNull()
    opens = F.coalesce((long & (F.col("len") > F.col("tail"))) | alone, F.lit(False))
    return known.withColumns({"opens": opens, "alone": alone}).where("covered OR alone").select("row_key", "place", "line_no", F.when(F.col("alone"), F.lit(1).cast("long")).otherwise(F.col("len")).alias("len"), "source", "opens")


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with ``text`` less its later copies of repeated runs, and n_lines, n_deleted, and n_runs, the maximal runs of which these are copies."""
    docs, restored = set_aside(docs.drop("n_lines", "n_deleted", "n_runs"), "row_key", "_gone", "_lines")
    keyed = row_keyed(docs, id_col)
    with passing(docs.sparkSession) as stays:
        gone = copied_lines(keyed.select("row_key", F.col(text).alias("text")), min_lines, min_words).groupBy("row_key").agg(F.collect_set("line_no").alias("_gone"), F.count_if("opens").cast("long").alias("n_runs"))
        gone = stays(staged(gone, "gone"))
    # places that stay are found by a hash set, so a text of many lines and deletions takes linear time
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    kept = F.array_join(F.transform(places, lambda i: F.get("_lines", i)), "\n")
    out = (
        keyed.join(gone.hint("merge"), "row_key", "left")  # gone grows with the documents: never broadcast
        .withColumn("_lines", F.split(text, "\n"))
        .withColumns({"n_lines": F.when(F.length(text) > 0, F.size("_lines")).otherwise(0).cast("long"), "n_deleted": F.when(F.col("_gone").isNotNull(), F.size("_gone")).otherwise(0).cast("long"), "n_runs": F.coalesce("n_runs", F.lit(0)).cast("long")})
        .withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept))
        .select(*docs.columns, "n_lines", "n_deleted", "n_runs")
    )
    return restored(out)
