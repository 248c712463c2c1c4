"""Chunks of a document assembled level by level, with the proof that nothing is lost: pages, sections below headings, leaves within a limit.

Every chunk is a range of its page's characters. The ranges of a level cover the range of the level above exactly, and
each chunk names its parent by id and by the digest of the parent's text, up to the page, whose link is the digest of its own. ``cover_violations`` and
``link_violations`` judge any table of that shape, whoever made it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docloom.operators.chunks import STRUCTURAL, stable_id
from docloom.operators.lines import HEADING

COLUMNS = ("document", "page", "level", "chunk_id", "parent_id", "parent_digest", "digest", "link", "start", "end", "title", "text")


def placed_lines(pages: DataFrame) -> DataFrame:
    """(document, page, start, end, line) of the lines of pages (document, page, text), ``end`` past the line's break."""
    lines = pages.where(F.length("text") > 0).select("document", "page", F.length("text").alias("_all"), F.posexplode(F.split("text", "\n", -1)).alias("_no", "line"))
    before = W.partitionBy("document", "page").orderBy("_no").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int")
    return lines.withColumn("start", start).select("document", "page", "start", F.least(F.col("start") + F.length("line") + 1, "_all").alias("end"), "line").where("start < end")


def pack_starts(pieces: Column, limit: int) -> Column:
    """Where packs begin: pieces (an array of start and end, in order and without gaps) go on with a pack while it stays within the limit. Only the starts are carried from step to step."""
    state = lambda starts, at: F.struct(starts.alias("starts"), at.alias("at"))
    begin = state(F.array().cast("array<int>"), F.lit(None).cast("int"))

    def step(s: Column, p: Column) -> Column:
        fits = s["at"].isNotNull() & (p["end"] - s["at"] <= limit)
        return F.when(fits, s).otherwise(state(F.concat(s["starts"], F.array(p["start"])), p["start"]))

    return F.aggregate(pieces, begin, step, lambda s: s["starts"])


def assembled(pages: DataFrame, limit: int = STRUCTURAL, prefix: str = "asm_") -> DataFrame:
    """COLUMNS of the chunks of pages (document, page, text), levels page, section and leaf.

    A section runs from a heading to the next one (the first from the top of the page); leaves are whole lines of a section up to ``limit``
    characters, a longer line cut at the limit. A page without text has no chunks. Pages of one document and number are one error of
    ``link_violations``: their ids differ by their texts alone.
    """
    whole = pages.where(F.length("text") > 0).select(F.col("document").cast("string").alias("document"), F.col("page").cast("int").alias("page"), "text")
    lines = placed_lines(whole)
    heading = F.col("line").rlike(HEADING)
    upto = W.partitionBy("document", "page").orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    sectioned = lines.withColumn("section", F.sum(heading.cast("int")).over(upto))
    title = F.max(F.when(heading, F.regexp_extract("line", HEADING, 2)))
    pieces = sectioned.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("end") - F.col("start")) / limit).cast("int") - 1))))
    pieces = pieces.withColumns({"_a": F.col("start") + F.col("piece") * limit, "_b": F.least("end", F.col("start") + (F.col("piece") + 1) * limit)})
    sections = pieces.groupBy("document", "page", "section").agg(F.min("start").alias("start"), F.max("end").alias("end"), title.alias("title"), F.array_sort(F.collect_list(F.struct(F.col("_a").alias("start"), F.col("_b").alias("end")))).alias("_pieces"))
    sections = sections.withColumn("_starts", pack_starts(F.col("_pieces"), limit)).drop("_pieces", "section")
    digest = lambda c: F.sha2(c, 256)
    named = lambda level, text: stable_id(prefix, F.col("document"), F.col("page").cast("string"), F.lit(level), F.col("start").cast("string"), digest(text))
    page = whole.withColumns({"start": F.lit(0), "end": F.length("text"), "digest": digest("text")}).withColumn("page_id", named("page", F.col("text"))).withColumn("page_link", F.col("digest"))
    below = page.select("document", "page", F.col("text").alias("_page"), "page_id", F.col("digest").alias("page_digest"), "page_link").join(sections, ["document", "page"])
    part = F.substring(F.col("_page"), F.col("start") + 1, F.col("end") - F.col("start"))
    below = below.withColumn("text", part).withColumn("digest", digest("text")).withColumn("section_id", named("section", F.col("text"))).withColumn("section_link", digest(F.concat_ws("\u001f", "page_link", "digest")))
    ends = F.concat(F.slice("_starts", 2, F.size("_starts")), F.array("end"))
    leaves = below.select("document", "page", "title", "_page", "section_id", F.col("digest").alias("section_digest"), "section_link", F.explode(F.arrays_zip(F.col("_starts").alias("start"), ends.alias("end"))).alias("_x")).select("*", "_x.start", "_x.end")
    leaves = leaves.withColumn("text", part).withColumn("digest", digest("text"))
    none = F.lit(None).cast("string")
    rows = [
        page.select("document", "page", F.lit("page").alias("level"), F.col("page_id").alias("chunk_id"), none.alias("parent_id"), none.alias("parent_digest"), "digest", F.col("page_link").alias("link"), "start", "end", none.alias("title"), "text"),
        below.select("document", "page", F.lit("section").alias("level"), F.col("section_id").alias("chunk_id"), F.col("page_id").alias("parent_id"), F.col("page_digest").alias("parent_digest"), "digest", F.col("section_link").alias("link"), "start", "end", "title", "text"),
        leaves.select("document", "page", F.lit("leaf").alias("level"), named("leaf", F.col("text")).alias("chunk_id"), F.col("section_id").alias("parent_id"), F.col("section_digest").alias("parent_digest"), "digest", digest(F.concat_ws("\u001f", "section_link", "digest")).alias("link"), "start", "end", "title", "text"),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def cover_violations(parts: DataFrame, wholes: DataFrame, by: list[str]) -> DataFrame:
    """(by, start, end, rule) of where parts (by, start, end) don't cover wholes (by, start, end; one row a key) exactly: gaps, overlaps, and parts outside or empty."""
    ordered = W.partitionBy(*by).orderBy("start", "end")
    real = parts.where("start < end")
    inside = real.join(wholes.select(*by, F.col("start").alias("_lo"), F.col("end").alias("_hi")), by)
    reach = F.max("end").over(ordered.rowsBetween(W.unboundedPreceding, -1))
    placed = inside.withColumns({"_reach": F.coalesce(reach, F.col("_lo")), "_last": F.lead("start").over(ordered).isNull(), "_end": F.max("end").over(ordered.rowsBetween(W.unboundedPreceding, 0))})
    rule = lambda rows, a, b, name: rows.select(*by, a.alias("start"), b.alias("end"), F.lit(name).alias("rule"))
    c = F.col
    out = [
        rule(placed.where("start > _reach"), c("_reach"), c("start"), "gap"),
        rule(placed.where("_last AND _end < _hi"), c("_end"), c("_hi"), "gap"),
        rule(placed.where("start < _reach AND start >= _lo"), c("start"), F.least("end", "_reach"), "overlap"),
        rule(placed.where("start < _lo OR end > _hi"), c("start"), c("end"), "outside"),
        rule(wholes.where("start < end").join(real.select(*by).distinct(), by, "left_anti"), c("start"), c("end"), "gap"),
        rule(parts.where("start >= end").join(wholes.select(*by), by, "left_semi"), c("start"), c("end"), "empty"),
        rule(parts.join(wholes.select(*by), by, "left_anti"), c("start"), c("end"), "outside"),
    ]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def assembly_cover(chunks: DataFrame) -> DataFrame:
    """Cover violations of sections over pages and of leaves over sections: (parent_id, start, end, rule)."""
    children = chunks.where("parent_id IS NOT NULL").select("parent_id", "start", "end")
    wholes = chunks.where("level <> 'leaf'").select(F.col("chunk_id").alias("parent_id"), "start", "end")
    return cover_violations(children, wholes, ["parent_id"])


def link_violations(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(chunk_id, rule) of broken links: digests that aren't the text's, parents that are missing or have another digest, text that doesn't stand at its place, links that don't follow from the parent's, pages that aren't the source's, ids and pages given twice."""
    rule = lambda rows, name, key="chunk_id": rows.select(F.col(key).alias("chunk_id"), F.lit(name).alias("rule"))
    own = chunks.withColumn("_true", F.sha2("text", 256))
    parents = own.select(F.col("chunk_id").alias("parent_id"), F.col("level").alias("_level"), F.col("_true").alias("_parent"), F.col("text").alias("_whole"), F.col("start").alias("_lo"), F.col("link").alias("_link"), F.col("document").alias("_document"))
    met = own.where("level <> 'page'").join(parents, "parent_id", "left")
    source = pages.where(F.length("text") > 0).select(F.col("document").cast("string").alias("document"), F.col("page").cast("int").alias("page"), F.sha2("text", 256).alias("_source"))
    tops = own.where("level = 'page'").join(source, ["document", "page"], "left")
    above = F.when(F.col("level") == "section", "page").otherwise("section")
    there = F.substring(F.col("_whole"), F.col("start") - F.col("_lo") + 1, F.col("end") - F.col("start"))
    out = [
        rule(own.where("digest <> _true"), "digest"),
        rule(met.where("_parent IS NULL"), "parent_missing"),
        rule(met.where((F.col("_level") != above) | (F.col("document") != F.col("_document"))), "parent_level"),
        rule(met.where("parent_digest <> _parent"), "parent_digest"),
        rule(met.where(there != F.col("text")), "not_in_parent"),
        rule(met.where(F.col("link") != F.sha2(F.concat("_link", F.lit("\u001f"), "_true"), 256)), "link"),
        rule(tops.where("_source IS NULL OR _source <> _true OR link <> _true"), "not_the_source"),
        rule(source.join(own.where("level = 'page'"), ["document", "page"], "left_anti").withColumn("_id", F.concat_ws("/", "document", "page")), "page_missing", "_id"),
        rule(chunks.groupBy("chunk_id").count().where("count > 1"), "id_twice"),
        rule(source.groupBy("document", "page").count().where("count > 1").withColumn("_id", F.concat_ws("/", "document", "page")), "page_twice", "_id"),
    ]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def uncovered_scopes(chunks: DataFrame, scopes: DataFrame) -> DataFrame:
    """Scopes (document, page, start, end, ...) that no one leaf holds whole: what was approved as one quotation may not be torn."""
    leaves = chunks.where("level = 'leaf'").select("document", "page", F.col("start").alias("_a"), F.col("end").alias("_b"))
    whole = scopes.join(leaves, ["document", "page"]).where("_a <= start AND end <= _b").select(*scopes.columns).distinct()
    return scopes.join(whole, scopes.columns, "left_anti")
