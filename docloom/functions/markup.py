"""Tables and pages in markdown and HTML, with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Page markers of the text sources.
PAGE_MARKERS = {"plain": r"(?mi)^(?:\[page\s*(\d+)\]|=+\s*page\s*(\d+)\s*=+)\s*$", "comment": r"<!--\s*page\s*(\d+)\s*-->", "vision": r"(?m)^\[PAGE\s*(\d+)\]\s*$"}
RULE_CELL = r"^:?-{3,}:?$"


def marked_pages(text: Column, marker: str) -> Column:
    """Array of (page, text) between markers; a text without one is page 1."""
    pattern = PAGE_MARKERS[marker]
    numbers = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.regexp_extract(m, r"(\d+)", 1).cast("int"))
    parts = F.transform(F.slice(F.split(text, pattern), 2, 1 << 30), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", "")))
    marked = F.zip_with(numbers, parts, lambda n, p: F.struct(n.alias("page"), p.alias("text")))
    return F.when(F.size(numbers) > 0, marked).otherwise(F.array(F.struct(F.lit(1).alias("page"), F.trim(text).alias("text"))))


def cells(line: Column) -> Column:
    """Trimmed cells of one markdown table line."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))


def is_rule(line: Column) -> Column:
    return F.forall(cells(line), lambda c: c.rlike(RULE_CELL))


def table_rows(text: Column) -> Column:
    """Rows of cells of all lines with a pipe, delimiter lines left out."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains("|") & ~is_rule(x))
    return F.transform(lines, cells)


def is_table(unit: Column) -> Column:
    lines = F.filter(F.transform(F.split(unit, "\n"), F.trim), lambda x: x != "")
    return (F.size(lines) >= 2) & F.exists(lines, lambda x: x.rlike(r"^\|?\s*:?-{3,}")) & F.forall(lines, lambda x: x.contains("|"))


def html_table_shape(html: Column) -> Column:
    """(rows, widest row's cells) of a piece of HTML."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0))
    wide = F.array_max(F.transform(rows, lambda r: F.regexp_count(r, F.lit(r"(?i)<t[dh]\b"))))
    return F.struct(F.regexp_count(html, F.lit(r"(?i)<tr\b")).alias("rows"), F.coalesce(wide, F.lit(0)).alias("columns"))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def occurrences(text: Column, needle: Column) -> Column:
    """How often a needle occurs without overlap."""
    return F.when(F.length(needle) > 0, ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int")).otherwise(0)


def box(points: Column) -> Column:
    """The box around an array of (x, y)."""
    of = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return F.when(F.size(points) > 0, F.struct(of(F.array_min, "x").alias("x1"), of(F.array_min, "y").alias("y1"), of(F.array_max, "x").alias("x2"), of(F.array_max, "y").alias("y2")))


def coordinate_space(boxes: Column) -> Column:
    """relative if all corners lie in [0, 1.01], absolute if not, unknown without boxes."""
    near = F.forall(boxes, lambda b: F.forall(F.array(b["x1"], b["y1"], b["x2"], b["y2"]), lambda v: v.between(0, 1.01)))
    return F.when(F.coalesce(F.size(boxes), F.lit(0)) <= 0, "unknown").when(near, "relative").otherwise("absolute")


def first_text(*columns: Column) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in columns), F.lit(""))
