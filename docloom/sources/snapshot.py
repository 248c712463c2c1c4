"""Import of a saved snapshot: binary matrices and local database files as partitioned data sources, cross-checked with their tables.

``matrix_file`` reads a file in numpy's public array format by ranges of rows: each partition seeks to its bytes. ``local_table`` reads a
table of an SQLite file by ranges of row ids, read-only and immutable. Both are registered by ``register``; paths are those of a
folder that driver and executors share (matrices: any URI that Arrow's file systems open).
"""

from __future__ import annotations

import math
import sqlite3
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docloom.operators.lineage import differences

#: Rows of a partition, and of a batch within it.
ROWS, BATCH = 65_536, 4096


def _opened(path: str):
    where, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where.open_input_file(name)


def matrix_shape(path: str) -> tuple[int, int, np.dtype, int]:
    """(rows, columns, type, where the numbers begin) of a two-dimensional matrix of real numbers in row order."""
    with _opened(path) as file:
        version = np.lib.format.read_magic(file)
        read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
        if read is None:
            raise ValueError(f"{path}: array format {version} isn't known")
        shape, by_column, kind = read(file)
        at = file.tell()
        if len(shape) != 2 or by_column or kind.kind not in "fiu" or kind.hasobject:
            raise ValueError(f"{path} is no matrix of numbers in row order")
        if file.size() != at + shape[0] * shape[1] * kind.itemsize:
            raise ValueError(f"{path} isn't whole")
    return shape[0], shape[1], kind, at


class Rows(InputPartition):
    """Rows first .. last - 1."""

    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.step = path, rows
        self.rows, self.columns, self.kind, self.at = matrix_shape(path)

    def partitions(self) -> list[Rows]:
        return [Rows(a, min(a + self.step, self.rows)) for a in range(0, self.rows, self.step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        width = self.columns * self.kind.itemsize
        with _opened(self.path) as file:
            for a in range(partition.first, partition.last, BATCH):
                n = min(BATCH, partition.last - a)
                file.seek(self.at + a * width)
                values = np.frombuffer(file.read(n * width), self.kind).astype(np.float64)
                offsets = pa.array(np.arange(n + 1) * self.columns, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), pa.ListArray.from_arrays(offsets, pa.array(values))], ["row", "vector"])


class MatrixSource(DataSource):
    """Options: path, rowsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "matrix_file"

    def schema(self) -> str:
        return "row long, vector array<double>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options["path"], int(self.options.get("rowsPerPartition", ROWS)))


def _connected(path: str) -> sqlite3.Connection:
    """The file as it is: nothing is written to it or beside it."""
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro&immutable=1", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


#: Spark's types for the declared types of a column, by what the declaration contains; the first that fits.
KINDS = (("INT", "long"), ("CHAR", "string"), ("TEXT", "string"), ("CLOB", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))


class LocalTableReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], rows: int):
        self.path, self.table, self.columns, self.step = path, table, columns, rows

    def partitions(self) -> list[Rows]:
        with _connected(self.path) as base:
            first, last = base.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()  # noqa: S608
        if first is None:
            return [Rows(0, 0)]
        return [Rows(a, min(a + self.step, last + 1)) for a in range(first, last + 1, self.step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        names = ", ".join(map(_quoted, self.columns))
        base = _connected(self.path)
        try:
            yield from base.execute(f"SELECT {names} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.first, partition.last))  # noqa: S608
        finally:
            base.close()


class LocalTableSource(DataSource):
    """Options: path, dbtable, rowsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "local_table"

    def _declared(self) -> list[tuple[str, str]]:
        with _connected(self.options["path"]) as base:
            told = base.execute(f"PRAGMA table_info({_quoted(self.options['dbtable'])})").fetchall()
        if not told:
            raise ValueError(f"no table {self.options['dbtable']} in {self.options['path']}")
        return [(row[1], next((kind for mark, kind in KINDS if mark in row[2].upper()), "string")) for row in told]

    def schema(self) -> str:
        return ", ".join(f"`{name}` {kind}" for name, kind in self._declared())

    def reader(self, schema) -> LocalTableReader:
        return LocalTableReader(self.options["path"], self.options["dbtable"], [name for name, _ in self._declared()], int(self.options.get("rowsPerPartition", ROWS)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MatrixSource)
    spark.dataSource.register(LocalTableSource)


def matrix(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    """(row, vector) of a matrix file."""
    register(spark)
    return spark.read.format("matrix_file").option("path", path).option("rowsPerPartition", rows).load()


def local_table(spark: SparkSession, path: str, table: str, rows: int = ROWS) -> DataFrame:
    register(spark)
    return spark.read.format("local_table").option("path", path).option("dbtable", table).option("rowsPerPartition", rows).load()


def write_matrix(vectors: DataFrame, path: str, order: str = "row", vector: str = "vector", dims: int | None = None) -> int:
    """A matrix file of float32 rows in order, a task's rows at a time: the file is made in its whole size first, and each task writes to its own bytes. For folders that driver and executors share as a mounted path. Returns the rows."""
    from pyspark.sql.window import Window as W

    name = path.removeprefix("file://")
    parts = vectors.select(F.col(order).alias("o"), F.col(vector).cast("array<float>").alias("v")).repartitionByRange("o").sortWithinPartitions("o").withColumn("p", F.spark_partition_id())
    parts = parts.persist()
    try:
        # one row a partition
        sizes = parts.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).orderBy("p").collect()
        n = sum(r["n"] for r in sizes)
        wide = {r[c] for r in sizes for c in ("lo", "hi")} or {dims or 0}
        if len(wide) != 1:
            raise ValueError("vectors differ in length")
        columns = wide.pop()
        starts, at = {}, 0
        for r in sizes:
            starts[r["p"]] = at
            at += r["n"]
        with open(name, "wb") as file:
            np.lib.format.write_array_header_1_0(file, {"descr": "<f4", "fortran_order": False, "shape": (n, columns)})
            head = file.tell()
            file.truncate(head + 4 * n * columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done = 0
            for batch in batches:
                if batch.num_rows:
                    first = starts[batch.column(0)[0].as_py()]
                    with open(name, "r+b") as file:
                        file.seek(head + 4 * columns * (first + done))
                        file.write(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes())
                    done += batch.num_rows
            yield pa.RecordBatch.from_pydict({"n": pa.array([done], pa.int64())})

        written = parts.select("p", "v").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
        if written != n:
            raise RuntimeError(f"{written} of {n} rows were written")
        return n
    finally:
        parts.unpersist()


def snapshot_faults(corpus: DataFrame, chunks: DataFrame, numbered: DataFrame, rows: DataFrame, stored: DataFrame, told: dict) -> DataFrame:
    """(fault, id) of where the parts of a snapshot disagree; empty if it may be imported.

    corpus and chunks have the same columns, among them chunk_id; numbered: (row, chunk_id) is the order of the matrix; rows: (row, vector);
    stored: (chunk_id, vector) of the vector collection; told: the summary's chunks, dims, model and distance, and ``expected``, what the last two must be.
    Tables are compared in both directions, with multiplicity.
    """
    spark = corpus.sparkSession
    named = numbered.join(rows, "row", "full_outer")
    vectors = named.where("chunk_id IS NOT NULL AND vector IS NOT NULL").select("chunk_id", F.transform("vector", lambda x: x.cast("float")).alias("vector"))
    held = stored.select("chunk_id", F.transform("vector", lambda x: x.cast("float")).alias("vector"))
    out = [
        differences(corpus, chunks.select(*corpus.columns)).select(F.concat(F.lit("corpus_"), "side").alias("fault"), F.col("chunk_id").cast("string").alias("id")),
        named.where("chunk_id IS NULL OR vector IS NULL").select(F.lit("matrix_rows").alias("fault"), F.col("row").cast("string").alias("id")),
        differences(vectors, held).select(F.concat(F.lit("vectors_"), "side").alias("fault"), F.col("chunk_id").cast("string").alias("id")),
        corpus.select("chunk_id").exceptAll(vectors.select("chunk_id")).select(F.lit("without_vector").alias("fault"), F.col("chunk_id").cast("string").alias("id")),
        corpus.groupBy("chunk_id").count().where("count > 1").select(F.lit("chunk_twice").alias("fault"), F.col("chunk_id").cast("string").alias("id")),
        rows.where(F.size("vector") != told["dims"]).select(F.lit("dims").alias("fault"), F.col("row").cast("string").alias("id")),
        corpus.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != told["chunks"]).select(F.lit("count").alias("fault"), F.col("n").cast("string").alias("id")),
        spark.createDataFrame([("contract", k) for k, v in told["expected"].items() if told.get(k) != v], "fault string, id string"),
    ]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def partitions_of(rows: int, step: int = ROWS) -> int:
    return max(1, math.ceil(rows / step))
