"""Product codes of vectors by Lloyd's rounds whose sums are maintained by deltas.

Vectors become whole numbers and are cut into ``parts`` equal parts; each position has a codebook of ``entries``, which
starts as that part of the vectors with the smallest ids. A round reads the stored rows with their assignments so far, assigns every part to
the nearest entry and writes rows with the assignments after and before. Only parts whose assignment
changed contribute: plus to the entry they joined, minus to the one they left. Contributions are summed in each
task before they are shuffled as (part, entry, position) numbers, and added to the running sums, a table written each round. The driver
reads the sums, whose number depends on the codebooks and not on the rows, and an entry becomes the floor of sum through count.

Defined cases: rows with a null id, a null vector or null or non-finite components are left out, as are empty vectors and those that don't
have the length of the first one or can't be cut into equal parts; with fewer vectors than entries a codebook has as many entries as
there are vectors; repeated ids are separate rows, the least vector counting first in the start; ties go to the lower entry; an entry without
parts stays; rows of null labels share one sum; rounds end early when no part has moved; squared distances are exact below 2**53, and components farther than 2**26 from nought after scaling count as 2**26; a label whose errors leave 64 bits has a null sum; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: How far from nought a whole component may lie: beyond that it is moved here, so that no sum of rows leaves 64 bits.
FAR = float(1 << 26)
#: Labels up to which their sums are broadcast.
FEW_LABELS = 10_000
_SUMS = "part int, entry int, place int, n long"


def nearest_entries(V: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) of entries nearest to each part, the lower of equals, and the squared distances. books: (parts, entries, width)."""
    parts, _, width = books.shape
    codes, away = np.empty((len(V), parts), np.int64), np.empty((len(V), parts))
    for p in range(parts):
        X, C = V[:, p * width : (p + 1) * width].astype(float), books[p].astype(float)
        squared = (C * C).sum(axis=1) - 2 * X @ C.T
        codes[:, p] = squared.argmin(axis=1)
        away[:, p] = np.take_along_axis(squared, codes[:, p, None], 1)[:, 0] + (X * X).sum(axis=1)
    return codes, away


def matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """A column of packed rows, each of ``width`` numbers."""
    data = column.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    return np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(-1, width) if len(data) and offsets[-1] > offsets[0] else np.zeros((0, width), kind)


def packed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    size = rows.shape[1] * rows.itemsize
    return pa.array([x.tobytes() for x in np.ascontiguousarray(rows)], pa.binary()) if size else pa.array([b""] * len(rows), pa.binary())


def assigned(state: DataFrame, books: np.ndarray, kind: str) -> DataFrame:
    """state (id, label, v, code) with the new ``code`` of each row, the one ``before`` (none at first), and ``error``, the sum of its squared distances."""
    parts, entries, width = books.shape
    code = "u1" if entries <= 256 else "<i4"
    before = "code" if "code" in state.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, away = nearest_entries(matrix(batch.column("v"), kind, parts * width), books)
            old = batch.column(before) if before else pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("v"), packed(codes.astype(code)), old, pa.array(away.sum(axis=1).astype(np.int64))], ["id", "label", "v", "code", "before", "error"])

    label = state.schema["label"].dataType.simpleString()
    return state.select("id", "label", "v", *([before] if before else [])).mapInArrow(run, f"id long, label {label}, v binary, code binary, before binary, error long")


def deltas(state: DataFrame, books: np.ndarray, kind: str) -> DataFrame:
    """(part, entry, place, n): what changed assignments add to the sums; place -1 counts the parts. Summed in each task."""
    parts, entries, width = books.shape
    code = "u1" if entries <= 256 else "<i4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            V = matrix(batch.column("v"), kind, parts * width).astype(np.int64)
            now = matrix(batch.column("code"), code, parts).astype(np.int64)
            had = ~np.array(batch.column("before").is_null())
            then = np.full(now.shape, -1)
            if had.any():
                then[had] = matrix(batch.column("before").drop_null(), code, parts)
            for p in range(parts):
                moved = now[:, p] != then[:, p]
                X = V[moved, p * width : (p + 1) * width]
                np.add.at(sums[p], now[moved, p], X)
                np.add.at(counts[p], now[moved, p], 1)
                left = then[moved, p] >= 0
                np.subtract.at(sums[p], then[moved, p][left], X[left])
                np.subtract.at(counts[p], then[moved, p][left], 1)
        both = np.concatenate([counts[:, :, None], sums], axis=2)
        p, e, place = np.nonzero(both)
        yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "place": pa.array(place - 1, pa.int32()), "n": pa.array(both[p, e, place])})

    return state.where(~F.col("code").eqNullSafe(F.col("before"))).select("v", "code", "before").mapInArrow(run, _SUMS)


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Rows (id, label, code, error, label_error) with packed codes, and the codebooks (parts, entries, width)."""
    spark = vectors.sparkSession
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    kept = named.where(F.col("id").isNotNull() & (F.size("vector") > 0) & finite)
    first = kept.orderBy("id", "vector").limit(1).collect()
    dims = len(first[0]["vector"]) if first else parts
    kept = kept.where((F.size("vector") == dims) & F.lit(dims % parts == 0)).withColumn("vector", F.transform("vector", lambda x: F.floor(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), scale * x)))))
    start = [r[0] for r in kept.orderBy("id", "vector").limit(entries).select("vector").collect()]
    width = dims // parts
    books = np.array(start, np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2) if start else np.zeros((parts, 0, width), np.int64)
    if not start:
        return spark.createDataFrame([], f"id long, label {kept.schema['label'].dataType.simpleString()}, code binary, error long, label_error long"), books
    reach = kept.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0]
    kind = "<i2" if reach < 1 << 15 else "<i4" if reach < 1 << 31 else "<i8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                V = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims).astype(kind)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), packed(V)], ["id", "label", "v"])

    state = kept.mapInArrow(run, f"id long, label {kept.schema['label'].dataType.simpleString()}, v binary")
    running = spark.createDataFrame([], _SUMS)
    for _ in range(rounds):
        state = staged(assigned(state, books, kind), "assigned")
        running = staged(running.unionByName(deltas(state, books, kind)).groupBy("part", "entry", "place").agg(F.sum("n").alias("n")), "sums")
        # at most parts * entries * (width + 1) numbers, whatever the rows
        sums = np.zeros((parts, books.shape[1], width + 1), np.int64)
        for p, e, place, n in running.collect():
            sums[p, e, place + 1] = n
        used = sums[:, :, 0] > 0
        fresh = np.where(used[:, :, None], np.floor_divide(sums[:, :, 1:], np.maximum(1, sums[:, :, :1])), books)
        same = np.array_equal(fresh, books)
        books = fresh
        if same:
            break
    last = staged(assigned(state, books, kind).select("id", "label", "code", "error"), "codes")
    by_label = staged(last.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "labels")
    by_label = F.broadcast(by_label) if by_label.count() <= FEW_LABELS else by_label
    return last.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).drop("_label"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components as decimal numbers, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
