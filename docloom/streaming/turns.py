"""The life of conversation turns as keyed state: pending, then completed or failed.

An attempt holds its conversation for a lease. Events of an attempt that no longer holds it are stale; a
start while another attempt holds a live lease is busy; after the lease it takes over. The same steps run
over a stream (state kept by Spark between batches) and over a table (one conversation a group).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEASE_SECONDS = 600
OUTPUT = "conv_id long, at double, attempt_id string, kind string, outcome string, state string"
STATE = "attempt string, since double, state string"


def step(held: tuple[str | None, float, str], event: tuple[float, str, str], lease: float = LEASE_SECONDS) -> tuple[tuple[str | None, float, str], str]:
    """The state after an event (time, attempt, kind: start, complete or fail), and what came of it."""
    attempt, since, state = held
    at, own, kind = event
    if kind == "start":
        if state == "pending" and attempt == own:
            return held, "replayed"
        if state == "pending" and at < since + lease:
            return held, "busy"
        return (own, at, "pending"), "took_over" if state == "pending" else "accepted"
    if state != "pending" or attempt != own:
        return held, "stale"
    if at >= since + lease:
        return (own, since, "failed"), "expired"
    return (own, since, "completed" if kind == "complete" else "failed"), "accepted"


def _rows(conv: int, held: tuple, events: Iterable[tuple]) -> tuple[tuple, list[tuple]]:
    out = []
    for at, attempt, kind in events:
        held, outcome = step(held, (at, attempt, kind))
        out.append((conv, at, attempt, kind, outcome, held[2]))
    return held, out


_NAMES = ["conv_id", "at", "attempt_id", "kind", "outcome", "state"]


def outcomes(events: DataFrame) -> DataFrame:
    """(conv_id, at, attempt_id, kind, outcome, state) of a table of events (conv_id, at, attempt_id, kind).

    Conversations are dealt by their id and sorted within the task, which goes through them row by row: no conversation is gathered.
    """
    columns = ["conv_id", "at", "attempt_id", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held = object(), (None, 0.0, "none")
        for batch in batches:
            told, states = [], []
            for own, *event in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if own != conv:
                    conv, held = own, (None, 0.0, "none")
                held, outcome = step(held, tuple(event))
                told.append(outcome)
                states.append(held[2])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(told, pa.string()), pa.array(states, pa.string())], _NAMES)

    dealt = events.select(F.col("conv_id").cast("long"), F.col("at").cast("double"), F.col("attempt_id").cast("string"), F.col("kind").cast("string"))
    return dealt.repartition("conv_id").sortWithinPartitions(*columns).mapInArrow(run, OUTPUT)


def outcome_stream(events: DataFrame) -> DataFrame:
    """The same over a stream."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else (None, 0.0, "none")
        pdf = pd.concat(list(frames)).sort_values(["at", "attempt_id", "kind"])
        held, rows = _rows(int(key[0]), held, pdf[["at", "attempt_id", "kind"]].itertuples(index=False, name=None))
        state.update(held)
        yield pd.DataFrame(rows, columns=_NAMES)

    return events.select("conv_id", "at", "attempt_id", "kind").groupBy("conv_id").applyInPandasWithState(fold, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def once_per_request(requests: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """A stream of requests with repeats of (conv_id, request_id) within the watermark dropped."""
    return requests.withWatermark(time, late).dropDuplicatesWithinWatermark(["conv_id", "request_id"])


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts and sums by event-time window; works on tables and streams. An extension: the domain itself has no event-time windows."""
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(w, by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def resume(source: DataFrame, target: str, checkpoint: str):
    """Process what is new since the last run of the same checkpoint, then stop: a batch that resumes."""
    query = source.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
