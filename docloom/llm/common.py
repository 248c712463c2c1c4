"""What the operators share: written cuts of the lineage, row keys, Arrow batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes [\x20\x09-\x0D], on which bytes.split() splits: a word is what lies between them.
WORD = r"[^\x20\x09-\x0D]+"
#: A Java pattern for the same.
JAVA_WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only on a local master without that setting."""
    if named := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return named
    if (own := spark.conf.get("docloom.shared.dir", None)) is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="spark-docloom-")
        spark.conf.set("docloom.shared.dir", own)
    return own


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for a while."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def arrow_rows(spark: SparkSession, rows: int = 1000):
    """Hand rows to Python in batches of so many at most: texts and sets are long, and a batch is held on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    return setting(spark, key, str(min(rows, before) if before > 0 else rows))


def shuffles_dropped(spark: SparkSession):
    """A job's shuffle files go when it ends, not when the driver happens to collect its garbage: small jobs leave hundreds of files each."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


#: Tables that staged() wrote within the innermost passing().
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def tables_of(df: DataFrame) -> set[str]:
    """The tables of staged() that df reads."""
    return {m[0] for f in df.inputFiles() if (m := re.match(r".*/docloom-[^/]+-[0-9a-f]{32}(?=/)", f))}


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001


def dropped(*tables: DataFrame) -> None:
    """Delete tables as staged() gave them, which nothing reads any more."""
    for table in tables:
        for path in tables_of(table):
            _delete(table.sparkSession, path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged within go at the end, save what stays(df), the function given, was told of; that is left to a passing() around this one."""
    own: list[str] = []
    kept: set[str] = set()
    outer = _passing.get()

    def stays(df: DataFrame) -> DataFrame:
        kept.update(t.rpartition("/")[2] for t in tables_of(df))
        return df

    before = _passing.set(own)
    try:
        yield stays
    finally:
        _passing.reset(before)
        for path in own:
            if path.rpartition("/")[2] not in kept:
                _delete(spark, path)
            elif outer is not None:
                outer.append(path)


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df to a table of its own in the shared folder and read it back: lineage ends here, and rows stay as they are when tasks are rerun."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    if (own := _passing.get()) is not None:
        own.append(path)
    with arrow_rows(spark), shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def collected(df: DataFrame) -> list[Row]:
    """The few rows of df."""
    with shuffles_dropped(df.sparkSession):
        return df.select("*").collect()  # a plan keeps the setting it was made under


def row_keyed(docs: DataFrame, id_col: str = "doc_id", key: str = "row_key") -> DataFrame:
    """docs with a long ``key`` unique to each row: the id itself where ids are whole, else a number written beside the row."""
    n, distinct = docs.agg(F.count(F.lit(1)), F.count_distinct(id_col)).first()
    if n == distinct and docs.schema[id_col].dataType == T.LongType():
        return docs.withColumn(key, F.col(id_col).alias(key, metadata={"by_id": True}))
    return staged(docs.withColumn(key, F.monotonically_increasing_id()), "keys")


def by_id(keyed: DataFrame, key: str = "row_key") -> bool:
    """The keys that row_keyed() gave are the rows' own ids."""
    return bool(keyed.schema[key].metadata.get("by_id"))


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns of these names (an operator's own) renamed, and a function that gives them their names back."""
    aside = {n: f"_given_{n}" for n in docs.columns if n in names}
    return docs.withColumnsRenamed(aside), lambda out: out.withColumnsRenamed({new: n for n, new in aside.items()})


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The values of a string column as UTF-8; null: empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    binary = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for value in binary:
        yield value.as_py() or b""


#: The one object that a Python worker keeps between tasks, and what it was made from.
_kept: list[tuple[str, object]] = []


def kept(source: str, make: Callable[[str], object]) -> object:
    """make(source), kept by the worker until it makes another or runs another operator."""
    if not _kept or _kept[0][0] != source:
        _kept[:] = [(source, make(source))]
    return _kept[0][1]


def released() -> None:
    """Give memory that is free back to the system: a Python worker outlives its task, and a task of another operator follows."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 19, keeps: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``most`` bytes of the text column (or one row). What another operator kept in this worker is dropped unless ``keeps``."""
    if not keeps:
        _kept.clear()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // most
        at = 0
        for end in [*(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]:
            if end > at:
                yield batch.slice(at, end - at)
            at = end
        del batch
    released()
