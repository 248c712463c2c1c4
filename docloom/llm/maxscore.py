"""Exact top-k by inner product with MaxScore over the postings of each shard.

A term is a component, a posting the integer weight a vector has in it. For a query, a term adds at
most its bound: the larger of weight times the largest and weight times the smallest posting of the
shard. Terms are taken by falling spread of bound; a threshold comes from vectors scored in full; the tail of terms that
cannot lift a vector over the threshold by itself is non-essential. Essential postings are traversed
for all vectors of the shard; the rest are probed only for vectors that still can reach the
threshold, a few terms at a time. Shards are merged by a window over each query's few best.

Defined cases: null or empty vectors and vectors with null or non-finite components take no part;
vectors of another length than the query's are no candidates; ties go to the smaller id; weights may be
negative; sums of products are exact below 2**53. See blocks.search for repeated ids.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from docloom.llm.blocks import search, top_of_block

#: Terms probed between two cuts of the competitive vectors.
STEP = 8


def quantized(X: np.ndarray, scale: int = 256) -> np.ndarray:
    return np.floor(scale * X)


def block_top(ids: np.ndarray, D: np.ndarray, qids: np.ndarray, Q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, vector place, score) of the k best vectors of the shard for each query, own ids left out."""
    n, terms = D.shape
    m = len(Q)
    none = np.zeros(0, np.int64)
    if not n or not m:
        return none, none, none
    high, low = D.max(axis=0), D.min(axis=0)
    upper, lower = np.maximum(Q * high, Q * low), np.minimum(Q * high, Q * low)
    order = np.argsort(lower - upper, axis=1, kind="stable")
    upper, lower = np.take_along_axis(upper, order, 1), np.take_along_axis(lower, order, 1)
    rest = np.concatenate([np.cumsum(upper[:, ::-1], axis=1)[:, ::-1], np.zeros((m, 1))], axis=1)  # rest[:, t]: the most that terms t.. can add
    # threshold: the k-th best full score among vectors that are strong in the first terms
    Qo = np.take_along_axis(Q, order, 1)
    lead = np.zeros_like(Q, dtype=float)
    np.put_along_axis(lead, order[:, : terms // 4 + 1], Qo[:, : terms // 4 + 1], 1)
    first = lead @ D.T
    own = ids[None, :] == qids[:, None]
    first[own] = -np.inf
    take = min(n, 4 * k)
    seeds = np.argpartition(-first, take - 1, axis=1)[:, :take]
    full = np.einsum("qst,qt->qs", D[seeds], Q)
    full[np.take_along_axis(own, seeds, 1)] = -np.inf
    bar = np.partition(full, take - k, axis=1)[:, take - k] if take >= k else np.full(m, -np.inf)
    # terms from `split` on can't lift a vector with the least essential postings to the bar
    least = np.concatenate([np.zeros((m, 1)), np.cumsum(lower, axis=1)], axis=1)
    hopeless = least[:, :-1] + rest[:, :-1] < bar[:, None]
    split = np.where(hopeless.any(axis=1), terms - np.argmax(hopeless[:, ::-1], axis=1), terms // 4 + 1)
    split = np.maximum(split, terms // 4 + 1)
    essential = np.zeros_like(Q, dtype=float)
    np.put_along_axis(essential, order, np.where(np.arange(terms) < split[:, None], Qo, 0), 1)
    score = essential @ D.T
    score[own] = -np.inf
    qi, di = np.nonzero(score + np.take_along_axis(rest, split[:, None], 1) >= bar[:, None])
    got, at = score[qi, di], split[qi]
    while len(qi) and (at < terms).any():
        for _ in range(STEP):
            live = at < terms
            t = np.minimum(at, terms - 1)
            got = got + np.where(live, Qo[qi, t] * D[di, order[qi, t]], 0)
            at = np.minimum(at + 1, terms)
        keep = got + rest[qi, at] >= bar[qi]
        qi, di, got, at = qi[keep], di[keep], got[keep], at[keep]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ends = np.searchsorted(qi, np.arange(m + 1))
    for q in range(m):
        near, its = di[ends[q] : ends[q + 1]], got[ends[q] : ends[q + 1]]
        real = np.isfinite(its)
        near, its = near[real], its[real]
        top = top_of_block(-its, ids[near], k)
        out.append((np.full(len(top), q), near[top], its[top].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query's quantized vector."""

    def best(ids: np.ndarray, X: np.ndarray, qids: np.ndarray, Q: np.ndarray):
        return block_top(ids, quantized(X, scale), qids, quantized(Q, scale), k)

    return search(vectors, queries, k, best, "long", False)
