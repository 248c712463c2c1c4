"""The whole search of a query set as one job: scope, rank, fuse, balance, cut, rerank, collapse."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators import fusion, lexical, ranking

#: Levels of chunks that each profile may answer with.
PROFILES = {"card_page_section_benefit": ("section", "benefit"), "parent_child_bundle": ("structural",)}
WORKLIST = 50


@dataclass(frozen=True)
class SearchConfig:
    profile: str = "card_page_section_benefit"
    vector_weight: float = 0.4
    component_depth: int = 50
    candidate_depth: int = 20
    top_k: int = 3
    payload_bytes: int = 64_000
    targets: tuple[str, ...] | None = None
    owned: tuple[str, ...] | None = None
    fresh: tuple[str, ...] | None = None
    allowed: tuple[str, ...] | None = None

    def __post_init__(self):
        if self.profile not in PROFILES or not 0 <= self.vector_weight <= 1:
            raise ValueError("unknown profile or weight out of range")
        if min(self.component_depth, self.candidate_depth, self.top_k, self.payload_bytes) < 1:
            raise ValueError("depths and sizes must be positive")
        for name, most in (("targets", 5), ("owned", 106), ("fresh", 106)):
            if (keys := getattr(self, name)) is not None and (not 1 <= len(keys) <= most or len(set(keys)) != len(keys) or not all(k.strip() for k in keys)):
                raise ValueError(f"{name} must be 1 to {most} different keys")
        if self.fresh is not None and (self.owned is None or set(self.owned) & set(self.fresh)):
            raise ValueError("a comparison needs two disjoint scopes")
        if self.targets is not None and self.owned is not None and not set(self.targets) <= set(self.owned):
            raise ValueError("targets must belong to the owned keys")
        if self.targets is not None and self.allowed is not None and not set(self.targets) <= set(self.allowed):
            raise ValueError("the allowed scope can't remove targets")

    def scopes(self) -> list[tuple[str, ...] | None]:
        """Scopes ranked apart, in order; None is the whole corpus."""
        if self.fresh is not None:
            out = [self.owned, self.fresh]
        elif self.targets is not None:
            out = [(t,) for t in self.targets]
        else:
            out = [self.owned]
        if self.allowed is None:
            return out
        return [self.allowed if s is None else tuple(k for k in s if k in self.allowed) for s in out]

    @property
    def scoped(self) -> bool:
        return self.targets is not None or self.owned is not None


def scope_table(like: DataFrame, config: SearchConfig, card: str = "card") -> DataFrame:
    """(card, scope, ordinal) of the asked scopes."""
    rows = [(k, i, j) for i, s in enumerate(config.scopes()) for j, k in enumerate(s or ())]
    return like.sparkSession.createDataFrame(rows, f"{card} string, scope int, ordinal int")


def ranked_in_scopes(scored: DataFrame, chunks: DataFrame, config: SearchConfig, descending: bool = True) -> DataFrame:
    """(query, doc, rank): every scope ranked from 1 by itself, rows of all scopes together."""
    if config.scopes() == [None]:
        return lexical.top_k(scored, config.component_depth, descending=descending).select("query", "doc", "rank")
    scopes = F.broadcast(scope_table(scored, config))  # at most a few hundred keys
    rows = scored.join(chunks.select("doc", "card"), "doc").join(scopes, "card")
    return ranking.scoped_ranks(rows, "scope", config.component_depth, descending).select("query", "doc", "rank")


def search(chunks: DataFrame, keyword: DataFrame, vector: DataFrame | None, queries: DataFrame, config: SearchConfig = SearchConfig(), rerank: Callable[[list[str], list[str]], list[float]] | None = None) -> DataFrame:  # noqa: B008
    """(query, doc, card, rank, evidence_rank, status) of the evidence for each of (query, question).

    chunks: (doc, card, card_name, issuer, level, text, optional reranker_text); keyword and vector: (query, doc, score), distances for the
    latter. ``rerank``: questions and texts to scores, called a batch at a time.
    """
    parts = {"bm25": ranked_in_scopes(keyword, chunks, config)}
    weights = {"bm25": 1 - config.vector_weight, "vector": config.vector_weight}
    if config.vector_weight:
        if vector is None:
            raise ValueError("a vector weight needs vector scores")
        parts["vector"] = ranked_in_scopes(vector, chunks, config, descending=False)
    fused = fusion.weighted_rrf(parts, {n: weights[n] for n in parts}).join(chunks, "doc")
    eligible = F.col("level").isin(*PROFILES[config.profile])
    if config.scoped:
        fused = ranking.reranked(fused.where(eligible), ["rank", "doc"])
        fused = _balanced(fused, config)
    cut = fused.where(F.col("rank") <= WORKLIST).where(eligible)
    leaf = ranking.reranked(cut, ["rank", "doc"]).where(F.col("rank") <= max(config.candidate_depth, len(config.targets or ())))
    rows = leaf.join(queries.select("query", "question"), "query")
    if rerank is not None:
        rows = reranked_by(rows, rerank)
    rows = _balanced(rows, config)
    return ranking.collapse_in_budget(rows.select("query", "question", "doc", "card", "card_name", "issuer", "text", "rank"), max(config.top_k, len(config.targets or ())), budget=config.payload_bytes, skip_oversized=config.scoped)


def _balanced(rows: DataFrame, config: SearchConfig) -> DataFrame:
    """Target cards, or owned and fresh cards, in turn."""
    if config.fresh is not None:
        keyed = rows.join(F.broadcast(scope_table(rows, config)), "card")
        return ranking.round_robin(keyed, "scope").drop("scope", "ordinal", "turn")
    if config.targets is not None:
        keyed = rows.join(F.broadcast(scope_table(rows, config)), "card")
        return ranking.round_robin(keyed, "card", "scope").drop("scope", "ordinal", "turn")
    return rows


def reranked_by(rows: DataFrame, rerank: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """rows (query, question, doc, text, rank) in the order of a reranker's scores; ``prior_rank`` keeps the old one. Scores that aren't finite are an error."""

    @F.pandas_udf(T.DoubleType())
    def scored(question: pd.Series, text: pd.Series) -> pd.Series:
        out = pd.Series([float(x) for x in rerank(question.tolist(), text.tolist())])
        if len(out) != len(text) or not out.abs().lt(float("inf")).all():
            raise ValueError("the reranker returned other than finite scores for all")
        return out

    text = F.coalesce("reranker_text", "text") if "reranker_text" in rows.columns else F.col("text")
    judged = rows.withColumn("prior_rank", F.col("rank")).withColumn("score", scored(F.col("question"), text))
    return ranking.reranked(judged, [F.col("score").desc(), "prior_rank", "doc"])


def hybrid(keyword: DataFrame, vector: DataFrame | None, mode: str, depth: int = 50, alpha: float = 0.5) -> DataFrame:
    """(query, doc, score, rank) of one of the modes keyword, vector, hybrid (ranks fused) and weighted (scaled scores fused); vector scores are similarities."""
    word = lexical.top_k(keyword, depth)
    if mode == "keyword":
        return word
    if vector is None:
        raise ValueError("this mode needs vector scores")
    near = lexical.top_k(vector, depth)
    if mode == "vector":
        return near
    if mode == "hybrid":
        return fusion.rrf([word, near])
    if mode == "weighted":
        return fusion.alpha_fusion(word, near, alpha)
    raise ValueError(f"unknown mode {mode}")


def unserved(asked: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Asked scopes for which no evidence was found."""
    return asked.select(*keys).distinct().join(evidence.select(*keys), keys, "left_anti")
