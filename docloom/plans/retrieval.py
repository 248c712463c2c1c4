"""Queries of search: BM25, vectors, fusion, balances, cuts and collapses. The query set is the benchmark table, whole."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docloom.operators import collection, fusion, lexical, ranking, vectors
from docloom.plans.catalogue import query, read
from docloom.session import shared_folder
from docloom.sources import writers

DEPTH = 50


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents")


def _index(spark: SparkSession, sf: str) -> lexical.Index:
    """The stored index of the documents: the first query of the application writes it, the rest read it."""
    return writers.stored_postings(_docs(spark, sf), "doc_id", lexical.ascii_tokens(F.col("text")), f"{shared_folder(spark)}/index-{spark.sparkContext.applicationId}")


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.query_terms(read(spark, sf, "benchmark"), "item_id", lexical.ascii_tokens(F.col("text")))


def _keyword_top(spark: SparkSession, sf: str, k: int = DEPTH, only: DataFrame | None = None) -> DataFrame:
    """The k best documents of each query, from the index's blocks."""
    return lexical.best_documents(_index(spark, sf), _terms(spark, sf), k, only=only)


def _vector(spark: SparkSession, sf: str, measure: str = "l2") -> DataFrame:
    """The DEPTH nearest. The vector of the same number stands for the embedding of a query text."""
    items = read(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id"))
    emb = read(spark, sf, "embeddings")
    return vectors.nearest(emb.join(items, "vec_id", "left_semi"), emb, DEPTH, measure).drop("rank")


_BM25_SQL = """
tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z]+') AS t FROM documents),
dl AS (SELECT doc_id AS doc, len(t) AS dl, t FROM tok),
post AS (SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, dl, unnest(t) AS term FROM dl) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
corpus AS (SELECT count(*) AS n_docs, avg(dl) AS avg_dl FROM dl),
qt AS (SELECT item_id AS query, unnest(list_distinct(regexp_extract_all(lower(text), '[0-9a-z]+'))) AS term FROM benchmark),
bm AS (SELECT query, doc, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))), 9) AS score
  FROM qt JOIN df USING (term), corpus, post WHERE post.term = qt.term GROUP BY query, doc),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INT AS rank FROM bm) WHERE rank <= 50)"""
_VEC_SQL = """
l2 AS (SELECT q.vec_id AS query, d.vec_id AS doc, round(list_sum([((d.embedding[i] - q.embedding[i]) * (d.embedding[i] - q.embedding[i]))::DOUBLE FOR i IN range(1, len(q.embedding) + 1)]), 9) AS score
  FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id, embeddings d),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score, doc)::INT AS rank FROM l2) WHERE rank <= 50)"""


@query("stored_index_terms", f"WITH {_BM25_SQL} SELECT term, df FROM df")
def stored_index_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The terms of the stored index: the first query of an application pays for writing it."""
    return _index(spark, sf).terms.select("term", "df")


@query("bm25_topk", f"WITH {_BM25_SQL} SELECT query, doc, round(score, 6) AS score, rank FROM kw")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _keyword_top(spark, sf).select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query(
    "fts_bm25_topk",
    f"WITH {_BM25_SQL}, f AS (SELECT query, doc, round(sum(greatest(1e-6::DOUBLE, ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))), 9) AS score FROM qt JOIN df USING (term), corpus, post WHERE post.term = qt.term GROUP BY query, doc) SELECT query, doc, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INT AS rank FROM f) WHERE rank <= 50",
)
def fts_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.best_documents(_index(spark, sf), _terms(spark, sf), DEPTH, full_text=True).select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query("l2_topk", f"WITH {_VEC_SQL} SELECT query, doc, round(score, 6) AS score, rank FROM vec")
def l2_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.top_k(_vector(spark, sf), DEPTH, descending=False).select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query(
    "cosine_topk",
    "WITH c AS (SELECT q.vec_id AS query, d.vec_id AS doc, round(list_sum([d.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE FOR i IN range(1, len(q.embedding) + 1)]) / (sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN d.embedding])) * sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN q.embedding]))), 9) AS score FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id, embeddings d) SELECT query, doc, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INT AS rank FROM c) WHERE rank <= 50",
)
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.top_k(_vector(spark, sf, "cosine"), DEPTH).select("query", "doc", F.round("score", 6).alias("score"), "rank")


def _lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return _keyword_top(spark, sf), lexical.top_k(_vector(spark, sf), DEPTH, descending=False)


@query("rrf_fuse", f"WITH {_BM25_SQL}, {_VEC_SQL}, s AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT query, doc, rank FROM kw UNION ALL SELECT query, doc, rank FROM vec) GROUP BY query, doc) SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INT AS rank FROM s")
def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.rrf(list(_lists(spark, sf)))


_FUSED = f"{_BM25_SQL}, {_VEC_SQL}, s AS (SELECT query, doc, round(sum(w / (60 + rank)), 12) AS score, min(rank) AS best, min(rank) FILTER (WHERE c = 'bm25') AS rank_bm25, min(rank) FILTER (WHERE c = 'vector') AS rank_vector FROM (SELECT query, doc, rank, 0.6::DOUBLE AS w, 'bm25' AS c FROM kw UNION ALL SELECT query, doc, rank, 0.4::DOUBLE, 'vector' FROM vec) GROUP BY query, doc), fused AS (SELECT query, doc, score, rank_bm25, rank_vector, row_number() OVER (PARTITION BY query ORDER BY score DESC, best, doc)::INT AS rank FROM s)"


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    keyword, vector = _lists(spark, sf)
    return fusion.weighted_rrf({"bm25": keyword, "vector": vector}, {"bm25": 0.6, "vector": 0.4})


@query("weighted_rrf", f"WITH {_FUSED} SELECT * FROM fused")
def weighted_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf)


_MM = "CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS x"


@query("alpha_fuse_minmax", f"WITH {_BM25_SQL}, {_VEC_SQL}, a AS (SELECT query, doc, {_MM} FROM (SELECT query, doc, -score AS score FROM vec) WINDOW w AS (PARTITION BY query)), b AS (SELECT query, doc, {_MM} FROM kw WINDOW w AS (PARTITION BY query)), f AS (SELECT query, doc, round(0.5::DOUBLE * coalesce(a.x, 0) + 0.5::DOUBLE * coalesce(b.x, 0), 9) AS score FROM a FULL JOIN b USING (query, doc)) SELECT query, doc, round(score, 6) AS score FROM f")
def alpha_fuse_minmax(spark: SparkSession, sf: str) -> DataFrame:
    keyword, vector = _lists(spark, sf)
    return fusion.alpha_fusion(keyword, vector.withColumn("score", -F.col("score")), 0.5).select("query", "doc", F.round("score", 6).alias("score"))


@query("scoped_rank_per_group", f"WITH {_BM25_SQL}, s AS (SELECT query, doc, round(score, 6) AS score, source, row_number() OVER (PARTITION BY query, source ORDER BY score DESC, doc)::INT AS rank FROM bm JOIN documents ON doc_id = doc WHERE source IN ('src1', 'src2', 'src3')) SELECT * FROM s WHERE rank <= 5")
def scoped_rank_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """The best of each scope from the index's blocks: no row is made of a posting."""
    scope = lambda s: _docs(spark, sf).where(F.col("source") == s).select(F.col("doc_id").alias("doc"))
    best = [_keyword_top(spark, sf, 5, scope(s)).withColumn("source", F.lit(s)) for s in ("src1", "src2", "src3")]
    return reduce(DataFrame.unionByName, best).select("query", "doc", F.round("score", 6).alias("score"), "source", "rank")


@query("global_stats_scoped_bm25", f"WITH {_BM25_SQL}, s AS (SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INT AS rank FROM bm JOIN documents ON doc_id = doc WHERE lang = 'en') SELECT * FROM s WHERE rank <= 10")
def global_stats_scoped_bm25(spark: SparkSession, sf: str) -> DataFrame:
    scope = _docs(spark, sf).where("lang = 'en'").select(F.col("doc_id").alias("doc"))
    return _keyword_top(spark, sf, 10, scope).select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query("bm25_with_unmatched", f"WITH {_BM25_SQL}, one AS (SELECT * FROM bm), z AS (SELECT q.query, d.doc_id AS doc, coalesce(one.score, 0) AS score FROM (SELECT DISTINCT item_id AS query FROM benchmark) q CROSS JOIN documents d LEFT JOIN one ON one.query = q.query AND one.doc = d.doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INT AS rank FROM z) SELECT query, doc, round(score, 6) AS score, rank FROM r WHERE rank <= 400")
def bm25_with_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    # scores are above 0: a query with fewer than 400 scored documents has them all among its best
    scored = _keyword_top(spark, sf, 400)
    asked = read(spark, sf, "benchmark").select(F.col("item_id").alias("query"))
    both = lexical.with_unmatched(scored, asked, _docs(spark, sf).select(F.col("doc_id").alias("doc")), 400)
    return lexical.top_k(both, 400).select("query", "doc", F.round("score", 6).alias("score"), "rank")


_ELIGIBLE = "lang IN ('en', 'de')"


def _eligible(spark: SparkSession, sf: str, scoped: bool) -> DataFrame:
    lang = _docs(spark, sf).select(F.col("doc_id").alias("doc"), "lang")
    rows = _fused(spark, sf).join(lang, "doc")
    return ranking.worklist(rows, F.expr(_ELIGIBLE), 50, 20, scoped).select("query", "doc", "rank")


@query("eligible_after_worklist", f"WITH {_FUSED}, e AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY rank, doc)::INT AS rank FROM fused JOIN documents ON doc_id = doc WHERE rank <= 50 AND {_ELIGIBLE}) SELECT * FROM e WHERE rank <= 20")
def eligible_after_worklist(spark: SparkSession, sf: str) -> DataFrame:
    return _eligible(spark, sf, False)


@query("eligible_before_worklist", f"WITH {_FUSED}, e AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY rank, doc)::INT AS rank FROM fused JOIN documents ON doc_id = doc WHERE {_ELIGIBLE}) SELECT * FROM e WHERE rank <= 20")
def eligible_before_worklist(spark: SparkSession, sf: str) -> DataFrame:
    return _eligible(spark, sf, True)


def _with_source(spark: SparkSession, sf: str) -> DataFrame:
    return _keyword_top(spark, sf).join(_docs(spark, sf).select(F.col("doc_id").alias("doc"), F.col("source").alias("card"), "text"), "doc")


@query("round_robin_balance", f"WITH {_BM25_SQL}, g AS (SELECT query, doc, source AS card, row_number() OVER (PARTITION BY query, source ORDER BY rank, doc)::INT AS turn FROM kw JOIN documents ON doc_id = doc) SELECT query, doc, card, row_number() OVER (PARTITION BY query ORDER BY turn, card, doc)::INT AS rank FROM g")
def round_robin_balance(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.round_robin(_with_source(spark, sf), "card").select("query", "doc", "card", "rank")


@query("group_balance", f"WITH {_BM25_SQL}, g AS (SELECT query, doc, (source IN ('src1', 'src2', 'src3', 'src4', 'src5'))::INT AS side, rank FROM kw JOIN documents ON doc_id = doc), t AS (SELECT *, row_number() OVER (PARTITION BY query, side ORDER BY rank, doc)::INT AS turn FROM g) SELECT query, doc, side, row_number() OVER (PARTITION BY query ORDER BY turn, side DESC, doc)::INT AS rank FROM t")
def group_balance(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_source(spark, sf).withColumn("side", F.col("card").isin("src1", "src2", "src3", "src4", "src5").cast("int")).withColumn("ordinal", -F.col("side"))
    return ranking.round_robin(rows, "side", "ordinal").select("query", "doc", "side", "rank")


@query("parent_expand", f"WITH {_BM25_SQL}, c AS (SELECT query, doc, score, rank, source AS parent FROM kw JOIN documents ON doc_id = doc), g AS (SELECT query, parent, round(max(score), 6) AS score, min(rank) AS best_rank, list(doc ORDER BY rank, doc)[1:2] AS sup FROM c GROUP BY query, parent), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY best_rank, score DESC, parent)::INT AS rank FROM g) SELECT query, parent, score, best_rank, sup[1] AS first_child, sup[2] AS second_child, rank, n_docs FROM r JOIN (SELECT source, count(*) AS n_docs FROM documents GROUP BY source) p ON p.source = parent WHERE rank <= 5")
def parent_expand(spark: SparkSession, sf: str) -> DataFrame:
    children = _with_source(spark, sf).withColumnRenamed("card", "parent")
    parents = _docs(spark, sf).groupBy(F.col("source").alias("parent")).agg(F.count(F.lit(1)).alias("n_docs"))
    return ranking.expand_parents(children, parents, 5).select("query", "parent", F.round("score", 6).alias("score"), "best_rank", F.get("support", F.lit(0)).alias("first_child"), F.get("support", F.lit(1)).alias("second_child"), "rank", "n_docs")


@query("collapse_cards", f"WITH {_BM25_SQL}, c AS (SELECT query, doc, rank, source AS card, min(rank) OVER (PARTITION BY query, source) AS first, row_number() OVER (PARTITION BY query, source ORDER BY rank, doc)::INT AS place FROM kw JOIN documents ON doc_id = doc), g AS (SELECT *, dense_rank() OVER (PARTITION BY query ORDER BY first, card)::INT AS group_rank FROM c) SELECT query, doc, card, rank, group_rank, row_number() OVER (PARTITION BY query ORDER BY rank, doc)::INT AS evidence_rank FROM g WHERE group_rank <= 3 AND place <= 5")
def collapse_cards(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.collapse(_with_source(spark, sf), "card", 3, 5).select("query", "doc", "card", "rank", "group_rank", "evidence_rank")


@query("collapse_in_budget")
def collapse_in_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_source(spark, sf).join(read(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("question")), "query")
    rows = rows.withColumns({"card_name": F.col("card"), "issuer": F.substring("card", 1, 3)})
    return ranking.collapse_in_budget(rows.select("query", "question", "doc", "card", "card_name", "issuer", "text", "rank"), budget=20_000)


@query("byte_budget_prefix", f"WITH {_BM25_SQL}, r AS (SELECT query, doc, rank, sum(strlen(text)) OVER (PARTITION BY query ORDER BY rank, doc)::BIGINT AS running FROM kw JOIN documents ON doc_id = doc) SELECT * FROM r WHERE running <= 24000")
def byte_budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_source(spark, sf).withColumn("bytes", F.octet_length("text").cast("long"))
    return ranking.prefix_within(rows, "bytes", 24_000).select("query", "doc", "rank", "running")


@query("truncated_context", f"WITH {_BM25_SQL}, r AS (SELECT query, doc, rank, text, 24000 - coalesce(sum(length(text)) OVER (PARTITION BY query ORDER BY rank, doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM kw JOIN documents ON doc_id = doc) SELECT query, doc, rank, length(substr(text, 1, rest::BIGINT))::INT AS used, md5(substr(text, 1, rest::BIGINT)) AS digest FROM r WHERE rest > 0")
def truncated_context(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.truncated_context(_with_source(spark, sf), "text", 24_000).select("query", "doc", "rank", F.length("text").alias("used"), F.md5("text").alias("digest"))


@query("bundle_select", f"WITH {_BM25_SQL}, s AS (SELECT query, source AS card, doc, row_number() OVER (PARTITION BY query, source ORDER BY rank, doc) AS n FROM kw JOIN documents ON doc_id = doc), f AS (SELECT query, card, doc FROM s WHERE n = 1), rel AS (SELECT a.source AS card, a.doc_id AS doc, b.doc_id AS other, row_number() OVER (PARTITION BY a.doc_id ORDER BY b.doc_id) AS place FROM documents a JOIN documents b ON a.source = b.source AND b.doc_id BETWEEN a.doc_id + 1 AND a.doc_id + 40), x AS (SELECT query, card, doc, 0 AS tier, 0 AS pos FROM f UNION ALL SELECT f.query, f.card, other, 1, place FROM f JOIN rel USING (card, doc) UNION ALL SELECT query, card, doc, 2, n FROM s WHERE n > 1), k AS (SELECT query, card, doc, min(tier * 1000000 + pos) AS key FROM x GROUP BY ALL), r AS (SELECT query, card, doc, row_number() OVER (PARTITION BY query, card ORDER BY key, doc)::INT AS place FROM k) SELECT * FROM r WHERE place <= 5")
def bundle_select(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select("doc_id", "source", F.floor(F.col("doc_id") / 40).alias("range"))
    # a document and the 40 after it lie in its range and the next: ids are compared within these alone
    a, b = docs.alias("a"), docs.withColumn("range", F.explode(F.array("range", F.col("range") - 1))).alias("b")
    near = a.join(b, (F.col("a.source") == F.col("b.source")) & (F.col("a.range") == F.col("b.range")) & F.col("b.doc_id").between(F.col("a.doc_id") + 1, F.col("a.doc_id") + 40))
    related = near.select(F.col("a.source").alias("card"), F.col("a.doc_id").alias("doc"), F.col("b.doc_id").alias("other"), F.row_number().over(W.partitionBy("a.doc_id").orderBy("b.doc_id")).alias("place"))
    return ranking.bundles(_with_source(spark, sf).select("query", "card", "doc", "rank"), related)


@query("collection_topk", f"WITH {_VEC_SQL} SELECT query, doc, round(score, 6) AS score, rank FROM vec")
def collection_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest vectors from a collection stored in cells, the query's own row among them as in l2_topk."""
    items = read(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id"))
    emb = read(spark, sf, "embeddings")
    root = f"{shared_folder(spark)}/docloom-collection-{uuid.uuid4().hex}"
    collection.write_collection(emb, root)
    found, _ = collection.search_collection(spark, root, emb.join(items, "vec_id", "left_semi"), DEPTH)
    return found.select("query", "doc", F.round("score", 6).alias("score"), "rank")
