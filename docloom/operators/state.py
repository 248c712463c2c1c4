"""Operational tables as append logs: latest rows, leases, pages of listings, checkpoints, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

LEASE_SECONDS = 600


def latest(log: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key in an append log. Null keys are equal."""
    w = W.partitionBy(*keys).orderBy(*(F.col(o).desc_nulls_last() for o in order))
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upserted(table: DataFrame, changes: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """table with the rows of changes in place of those with the same keys; of several changes of a key the last by ``order`` counts (without it, by all columns). Null keys are equal."""
    last = latest(changes, keys, *(order or [c for c in changes.columns if c not in keys]))
    match = [table[k].eqNullSafe(last[k]) for k in keys]
    return table.join(last, match, "left_anti").unionByName(last.select(table.columns))


def inserted(table: DataFrame, rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """table and those of rows whose keys it lacks; of rows with the same keys the first by ``order`` (without it, by all columns), nulls first."""
    first = W.partitionBy(*keys).orderBy(*(F.col(c).asc_nulls_first() for c in (order or [c for c in rows.columns if c not in keys])))
    new = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(table.columns)
    return table.unionByName(new.join(table, [new[k].eqNullSafe(table[k]) for k in keys], "left_anti"))


def next_number(log: DataFrame, keys: list[str], number: str) -> DataFrame:
    return log.groupBy(*keys).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next"))


def page_after(rows: DataFrame, order: tuple[str, str], cursor: tuple | None, size: int) -> DataFrame:
    """The rows after a cursor (first, second) in falling order of both columns: one more than ``size``, which tells whether a further page exists."""
    a, b = order
    if cursor is not None:
        x, y = (F.lit(v) for v in cursor)
        rows = rows.where((F.col(a) < x) | ((F.col(a) == x) & (F.col(b) < y)))
    return rows.orderBy(F.col(a).desc(), F.col(b).desc()).limit(size + 1)


def cursor_text(*columns: Column) -> Column:
    return F.base64(F.encode(F.to_json(F.array(*(c.cast("string") for c in columns))), "UTF-8"))


def completed_pairs(turns: DataFrame, by: list[str], order: str, role: str = "role", text: str = "text") -> DataFrame:
    """(by, order, question, answer) of user rows directly followed by an assistant row."""
    w = W.partitionBy(*by).orderBy(order)
    rows = turns.withColumns({"_next": F.lead(role).over(w), "_answer": F.lead(text).over(w)})
    return rows.where((F.col(role) == "user") & (F.col("_next") == "assistant")).select(*by, order, F.col(text).alias("question"), F.col("_answer").alias("answer"))


def recent_context(pairs: DataFrame, by: list[str], order: str, most_pairs: int = 2, most_chars: int = 6000) -> DataFrame:
    """The newest pairs, newest first, up to a number and a running size; the first that overflows ends it."""
    w = W.partitionBy(*by).orderBy(F.col(order).desc())
    size = F.sum(F.length("question") + F.length("answer")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return pairs.withColumns({"n": F.row_number().over(w), "chars": size}).where((F.col("n") <= most_pairs) & (F.col("chars") <= most_chars))


def leases(attempts: DataFrame, now: Column, started: str, seconds: int = LEASE_SECONDS) -> DataFrame:
    """attempts with ``lease``: held or expired at ``now``."""
    return attempts.withColumn("lease", F.when(F.col(started) + F.make_dt_interval(secs=F.lit(seconds)) <= now, "expired").otherwise("held"))


def several_pending(turns: DataFrame, by: list[str], state: str = "state") -> DataFrame:
    """Violations: more than one pending turn."""
    return turns.groupBy(*by).agg(F.count_if(F.col(state) == "pending").alias("pending")).where("pending > 1")


def replays(requests: DataFrame, by: list[str], request: str, payload: Column, order: str) -> DataFrame:
    """(by, request, first, tries, outcome): 'conflict' where one request id came with different payloads, 'replayed' or 'new' otherwise."""
    n = requests.groupBy(*by, request).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("tries"), F.count_distinct(payload).alias("payloads"))
    return n.select(*by, request, "first", "tries", F.when(F.col("payloads") > 1, "conflict").when(F.col("tries") > 1, "replayed").otherwise("new").alias("outcome"))


def unfinished(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose keys (such as id and content digest) no checkpoint has."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def open_ranges(ranges: DataFrame, done: DataFrame, by: list[str], start: str = "start", end: str = "end", item: str = "item") -> DataFrame:
    """Ranges with an item that isn't done, and how many of it."""
    items = ranges.select(*by, start, end, F.explode(F.sequence(start, end)).alias(item))
    return items.join(done.select(*by, item).distinct(), [*by, item], "left_anti").groupBy(*by, start, end).agg(F.count(F.lit(1)).alias("open_items"))


def preserved(fresh: DataFrame, old: DataFrame, same: list[str], kept: list[str]) -> DataFrame:
    """fresh rows with the ``kept`` columns of old rows that agree in ``same``, null where none does."""
    return fresh.join(old.select(*same, *kept).dropDuplicates(same), same, "left")


def recent_groups(events: DataFrame, by: list[str], group: str, order: str, most: int = 2) -> DataFrame:
    """The groups seen last: one seen again moves to the end."""
    seen = events.groupBy(*by, group).agg(F.max(order).alias("last"))
    return seen.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy(F.col("last").desc(), group))).where(F.col("n") <= most)


def merged_messages(messages: DataFrame, key: str, order: str, written: str) -> DataFrame:
    """Last write of each id, in order."""
    return latest(messages, [key], written).orderBy(order)


def embedding_status(rows: DataFrame, model: str) -> DataFrame:
    """One row: rows, those embedded by a model, and the distinct dimensions of these, in order."""
    own = F.col("embedding").isNotNull() & F.col("embedding_model").eqNullSafe(F.lit(model))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(own).alias("embedded"), F.array_sort(F.collect_set(F.when(own, F.size("embedding")))).alias("dimensions"))


def next_cases(cases: DataFrame, done: DataFrame, experiment: list[str], case: str, order: str, step: int = 5) -> DataFrame:
    """The next cases of each experiment that have no result yet, ``step`` at most: run, append the results, ask again."""
    left = cases.join(done.select(*experiment, case).distinct(), [*experiment, case], "left_anti")
    w = W.partitionBy(*experiment).orderBy(order, case)
    return left.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= step).drop("_n")


def stage_barrier(statuses: DataFrame, run: list[str], stages: list[str], done: str = "done") -> DataFrame:
    """(run, completed, stopped_before) of (run, item, stage, status): stages count up to the first that some item hasn't done; the next one may not begin."""
    wanted = statuses.select(*run, "item").distinct().withColumn("stage", F.explode(F.array(*map(F.lit, stages))))
    met = wanted.join(statuses.where(F.col("status") == done).select(*run, "item", "stage").distinct().withColumn("_done", F.lit(True)), [*run, "item", "stage"], "left")
    order = F.array_position(F.array(*map(F.lit, stages)), F.col("stage")).cast("int")
    first = met.groupBy(*run).agg(F.min(F.when(F.col("_done").isNull(), order)).alias("_open"))
    names = F.array(*map(F.lit, stages))
    return first.select(*run, F.slice(names, 1, F.coalesce(F.col("_open") - 1, F.lit(len(stages)))).alias("completed"), F.get(names, F.col("_open")).alias("stopped_before"))
