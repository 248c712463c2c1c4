"""Approximate nearest neighbours: multiprobe p-stable hashing with exact distance reranking.

Each table hashes a vector by ``functions`` projections on normal vectors, cut into cells of one width, in units
of the vectors' own length scale: the root mean squared distance from their mean, over all rows.
A query visits, over all tables, the ``probes`` buckets whose perturbation of its own cell is likeliest to
hold a near vector: perturbation sets come from a template in the order of their expected squared
distance to the cell borders, are scored by the query's own distances, and the best-scored are visited.
Candidates of all tables are merged and their exact distances computed.

Every row is indexed; the tables of a block of vectors live in that block, and each query visits
all blocks. Where a query's buckets hold fewer than k vectors of a block, all of the block are its candidates there, so
no query ends with fewer than k while there are more. Recall is measured against brute force in the tests.

Defined cases: null, zero, empty vectors and vectors with null or non-finite components take no part;
vectors of another length than the query's are no candidates; see blocks.search for repeated ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.blocks import search, top_of_block

TABLES, FUNCTIONS, WIDTH, PROBES, SEED = 16, 10, 2.0, 5000, 11
#: Queries whose probes are scored at once: their buckets' scores take some 40 MB.
AT_ONCE = 64


@lru_cache(maxsize=8)
def template(functions: int, most: int) -> np.ndarray:
    """Perturbation sets over the 2 * functions border distances in ascending order, by expected score: rows of 0/1, the empty set first."""
    k = functions
    j = np.arange(1, 2 * k + 1)
    r = 2 * k + 1 - j
    expected = np.where(j <= k, j * (j + 1) / (4 * (k + 1) * (k + 2)), 1 - r / (k + 1) + r * (r + 1) / (4 * (k + 1) * (k + 2)))
    sets: list[tuple[int, ...]] = [()]
    queue: list[tuple[float, tuple[int, ...]]] = [(expected[0], (1,))]
    while queue and len(sets) < most:
        score, chosen = heapq.heappop(queue)
        if all(2 * k + 1 - x not in chosen for x in chosen):  # a projection can't move both ways
            sets.append(chosen)
        if (last := chosen[-1]) < 2 * k:
            heapq.heappush(queue, (score - expected[last - 1] + expected[last], (*chosen[:-1], last + 1)))
            heapq.heappush(queue, (score + expected[last], (*chosen, last + 1)))
    rows = np.zeros((len(sets), 2 * k), dtype=bool)
    for i, chosen in enumerate(sets):
        rows[i, [x - 1 for x in chosen]] = True
    return rows


class Tables:
    """Hash functions of all tables; the same for every block, drawn from one seed."""

    def __init__(self, dims: int, tables: int, functions: int, width: float, seed: int):
        draw = np.random.default_rng([seed, dims, tables, functions])
        self.a = draw.standard_normal((dims, tables * functions)) / width
        self.b = draw.random(tables * functions)
        self.odd = draw.integers(0, 1 << 63, functions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shape = (tables, functions)

    def cells(self, X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers and places within the cell, as (vectors, tables, functions)."""
        at = (X @ self.a + self.b).reshape(len(X), *self.shape)
        cell = np.floor(at)
        return cell.astype(np.int64), at - cell

    def keys(self, cell: np.ndarray) -> np.ndarray:
        return (cell.astype(np.uint64) * self.odd).sum(axis=2, dtype=np.uint64)


@lru_cache(maxsize=8)
def hash_tables(dims: int, tables: int, functions: int, width: float, seed: int) -> Tables:
    return Tables(dims, tables, functions, width, seed)


def probe_keys(tables: Tables, Q: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the tables and keys of the ``probes`` buckets of best score."""
    sets = template(tables.shape[1], probes)
    cell, place = tables.cells(Q)
    border = np.concatenate([place, 1 - place], axis=2)  # to the cell below, to the cell above
    order = np.argsort(border, axis=2)
    squared = np.take_along_axis(border, order, axis=2) ** 2
    step = np.concatenate([np.uint64(0) - tables.odd, tables.odd])[order]
    base = tables.keys(cell)
    score = squared @ sets.T.astype(float)  # (queries, tables, sets)
    flat = score.reshape(len(Q), -1)
    take = min(probes, flat.shape[1])
    best = np.argpartition(flat, take - 1, axis=1)[:, :take]
    best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, axis=1), axis=1), axis=1)
    table, chosen = best // len(sets), best % len(sets)
    keys = np.empty(best.shape, np.uint64)
    for q in range(len(Q)):
        keys[q] = base[q, table[q]] + (step[q, table[q]] * sets[chosen[q]]).sum(axis=1, dtype=np.uint64)
    return table, keys


def candidates(tables: Tables, X: np.ndarray, table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """(queries, vectors) of bool: in one of the buckets that the query visits."""
    held = np.zeros((len(keys), len(X)), dtype=bool)
    own = tables.keys(tables.cells(X)[0])
    for t in range(tables.shape[0]):
        order = np.argsort(own[:, t], kind="stable")
        sorted_keys = own[order, t]
        q, p = np.nonzero(table == t)
        wanted = keys[q, p]
        low = np.searchsorted(sorted_keys, wanted, "left")
        many = np.searchsorted(sorted_keys, wanted, "right") - low
        at = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        held[np.repeat(q, many), order[at]] = True
    return held


def length_scales(vectors: DataFrame, vector_col: str = "embedding") -> dict[int, float]:
    """For each length of vectors the root mean squared distance from their mean: sums made in the tasks, then by component. Rounded, so that it doesn't depend on the order of sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for v in batch.column(0):
                if v.is_valid and len(v) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(float)
                    if np.isfinite(x).all() and x.any():
                        total = sums.setdefault(len(x), np.zeros(len(x) + 2))
                        total += np.append(x, [x @ x, 1.0])
        for dims, total in sums.items():
            yield pa.RecordBatch.from_pydict({"dims": pa.array([dims] * len(total), pa.int32()), "place": pa.array(range(len(total)), pa.int32()), "total": pa.array(total)})

    rows = vectors.select(vector_col).mapInArrow(run, "dims int, place int, total double").groupBy("dims", "place").agg(F.sum("total").alias("total")).collect()  # a row a component
    of: dict[int, dict[int, float]] = {}
    for r in rows:
        of.setdefault(r["dims"], {})[r["place"]] = r["total"]
    out = {}
    for dims, t in of.items():
        squared = t[dims] / t[dims + 1] - sum((t[i] / t[dims + 1]) ** 2 for i in range(dims))
        out[dims] = float(f"{max(squared, 0.0) ** 0.5:.5g}") or 1.0
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, probes: int = PROBES, seed: int = SEED, vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest candidates found of each query by Euclidean distance. ``width`` is in units of the vectors' own length scale."""
    scales = length_scales(vectors, vector_col)

    def best(ids: np.ndarray, X: np.ndarray, qids: np.ndarray, Q: np.ndarray):
        hashed = hash_tables(X.shape[1], tables, functions, width * scales.get(X.shape[1], 1.0), seed)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for first in range(0, len(Q), AT_ONCE):
            some = slice(first, first + AT_ONCE)
            held = candidates(hashed, X, *probe_keys(hashed, Q[some], probes))
            for q, mine in enumerate(held, first):
                others = ids != qids[q]
                near = np.flatnonzero(mine & others)
                if len(near) < k:
                    near = np.flatnonzero(others)
                score = np.sqrt(((X[near] - Q[q]) ** 2).sum(axis=1))
                top = top_of_block(score, ids[near], k)
                out.append((np.full(len(top), q), near[top], score[top]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    return search(vectors, queries, k, best, "double", True, vector_col=vector_col, zeros=False)
