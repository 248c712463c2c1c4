"""Cuts, balances and collapses of ranked rows (query, doc, rank, score)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def reranked(rows: DataFrame, order: list, partition: tuple[str, ...] = ("query",)) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*partition).orderBy(*order)))


def scoped_ranks(scored: DataFrame, scope: str, k: int, descending: bool = True) -> DataFrame:
    """Each scope of a query ranked apart: ranks start at 1 in every scope."""
    order = [F.col("score").desc() if descending else F.col("score").asc(), F.col("doc")]
    return reranked(scored, order, ("query", scope)).where(F.col("rank") <= k)


def worklist(ranked: DataFrame, eligible, depth: int, candidates: int, scoped: bool) -> DataFrame:
    """Unscoped queries are cut to ``depth`` before the eligibility filter, scoped ones after it; ``candidates`` remain."""
    cut = ranked.where(F.col("rank") <= depth).where(eligible) if not scoped else reranked(ranked.where(eligible), ["rank", "doc"]).where(F.col("rank") <= depth)
    return reranked(cut, ["rank", "doc"]).where(F.col("rank") <= candidates)


def round_robin(ranked: DataFrame, group: str, ordinal: str | None = None) -> DataFrame:
    """First rows of every group in the groups' order, then second rows, and so on; ``ordinal`` orders groups (default: the group itself)."""
    turn = F.row_number().over(W.partitionBy("query", group).orderBy("rank", "doc"))
    return reranked(ranked.withColumn("turn", turn), ["turn", ordinal or group, "doc"])


def expand_parents(children: DataFrame, parents: DataFrame, top_k: int, support: int = 2) -> DataFrame:
    """(query, parent, score, best_rank, support, rank) and the parent's columns: children (query, doc, parent, score, rank) by their parent."""
    got = children.groupBy("query", "parent").agg(
        F.max("score").alias("score"),
        F.min("rank").alias("best_rank"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", "doc"))), 1, support), lambda x: x["doc"]).alias("support"),
    )
    order = W.partitionBy("query").orderBy("best_rank", F.col("score").desc(), "parent")
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).join(parents, "parent")


def collapse(ranked: DataFrame, group: str, top_groups: int, per_group: int) -> DataFrame:
    """Rows of the first ``top_groups`` groups by first appearance, at most ``per_group`` each; adds group_rank and evidence_rank."""
    first = ranked.withColumn("first", F.min("rank").over(W.partitionBy("query", group)))
    numbered = first.withColumns({"group_rank": F.dense_rank().over(W.partitionBy("query").orderBy("first", group)), "place": F.row_number().over(W.partitionBy("query", group).orderBy("rank", "doc"))})
    kept = numbered.where((F.col("group_rank") <= top_groups) & (F.col("place") <= per_group))
    return kept.withColumn("evidence_rank", F.row_number().over(W.partitionBy("query").orderBy("rank", "doc"))).drop("first", "place")


def payload_bytes(question: str, evidence: list[dict]) -> int:
    """UTF-8 bytes of the compact JSON handed to an answering model."""
    return len(json.dumps({"standalone_query": question, "evidence": evidence}, ensure_ascii=False, separators=(",", ":")).encode())


def collapse_in_budget(ranked: DataFrame, top_groups: int = 3, per_group: int = 5, budget: int = 64_000, skip_oversized: bool = False) -> DataFrame:
    """(query, doc, card, rank, evidence_rank, status) of (query, question, doc, card, card_name, issuer, text, rank).

    A fold in rank order within each query: a row is 'kept', or 'dropped' for a full card list, a full card or the
    byte budget. At the first overflow the fold ends ('unread' after it) unless ``skip_oversized``; a first row that
    overflows is 'error'. A query's worklist is bounded by the depth it was cut to, so a query is one group.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "doc"]).drop_duplicates("doc")
        question = pdf["question"].iloc[0] or ""
        used = payload_bytes(question, [])
        per: dict = {}
        out, ended = [], False
        for row in pdf.itertuples(index=False):
            item = {"evidence_id": str(row.doc), "card_name": row.card_name, "issuer": row.issuer, "text": row.text}
            size = len(json.dumps(item, ensure_ascii=False, separators=(",", ":")).encode()) + (1 if per else 0)
            if ended:
                out.append((row, None, "unread"))
            elif (row.card not in per and len(per) >= top_groups) or per.get(row.card, 0) >= per_group:
                out.append((row, None, "dropped"))
            elif used + size > budget:
                ended = not skip_oversized
                out.append((row, None, "dropped" if per or skip_oversized else "error"))
            else:
                used += size
                per[row.card] = per.get(row.card, 0) + 1
                out.append((row, sum(per.values()), "kept"))
        return pd.DataFrame([(r.query, r.doc, r.card, r.rank, n, s) for r, n, s in out], columns=["query", "doc", "card", "rank", "evidence_rank", "status"]).astype({"evidence_rank": "Int32"})

    schema = f"query {ranked.schema['query'].dataType.simpleString()}, doc {ranked.schema['doc'].dataType.simpleString()}, card string, rank int, evidence_rank int, status string"
    return ranked.groupBy("query").applyInPandas(fold, schema)


def bundles(seeds: DataFrame, related: DataFrame, most: int = 5) -> DataFrame:
    """(query, card, doc, place): a card's best row, then rows related to it, then its other rows; each once, at most ``most``.

    seeds: (query, card, doc, rank); related: (card, doc, other, place).
    """
    best = seeds.withColumn("n", F.row_number().over(W.partitionBy("query", "card").orderBy("rank", "doc")))
    first = best.where("n = 1").select("query", "card", "doc")
    listed = first.select("query", "card", "doc", F.lit(0).alias("tier"), F.lit(0).cast("long").alias("at"))
    near = first.join(related, ["card", "doc"]).select("query", "card", F.col("other").alias("doc"), F.lit(1).alias("tier"), F.col("place").cast("long").alias("at"))
    rest = best.where("n > 1").select("query", "card", "doc", F.lit(2).alias("tier"), F.col("n").cast("long").alias("at"))
    rows = listed.unionByName(near).unionByName(rest).groupBy("query", "card", "doc").agg(F.min(F.struct("tier", "at")).alias("key"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("query", "card").orderBy("key", "doc"))).where(F.col("place") <= most).drop("key")


def prefix_within(rows: DataFrame, size: str, budget: int, partition: tuple[str, ...] = ("query",), order: tuple[str, ...] = ("rank", "doc")) -> DataFrame:
    """The rows before a running sum of ``size`` passes the budget."""
    running = F.sum(size).over(W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("running", running).where(F.col("running") <= budget)


def truncated_context(rows: DataFrame, text: str, budget: int) -> DataFrame:
    """Texts in rank order up to a character budget, the last one cut."""
    before = F.coalesce(F.sum(F.length(text)).over(W.partitionBy("query").orderBy("rank", "doc").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(budget) - before
    return rows.withColumn("left", left).where("left > 0").withColumn(text, F.expr(f"substring({text}, 1, cast(left as int))")).drop("left")




def following(rows: DataFrame, group: str, order: str, width: int = 4096) -> DataFrame:
    """(group, order, next): the next value of a whole-number column within a group, null for the last.

    Looked for within ranges of ``width`` values, and for the last of a range in a table of one row a range: no task
    sorts a whole group.
    """
    part = F.floor(F.col(order) / width)
    own = rows.select(group, order, part.alias("_part"))
    own = own.withColumn("_next", F.lead(order).over(W.partitionBy(group, "_part").orderBy(order)))
    firsts = own.groupBy(group, "_part").agg(F.min(order).alias("_first"))
    after = firsts.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), F.lead("_first").over(W.partitionBy(group).orderBy("_part")).alias("_after"))
    joined = own.join(after, own[group].eqNullSafe(after["_group"]) & (own["_part"] == after["_of"]))
    return joined.select(group, order, F.coalesce("_next", "_after").alias("next"))
