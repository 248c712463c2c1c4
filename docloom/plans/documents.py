"""Queries over the lines and marks of documents: registries, sections, trees, tables, chunks, identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import markup, text
from docloom.operators import assembly, chunks, lineage, lines
from docloom.plans.catalogue import query, read


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    return lines.registry(docs, "doc_id").select("doc_id", "line_no", "line_id", "text")


_L = r"""a AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1)::INT AS line_no FROM documents),
l AS (SELECT doc_id, line_no, line AS text FROM a WHERE trim(line) <> '')"""


@query("line_registry", f"WITH {_L} SELECT doc_id, line_no, printf('P%04d-L%04d', 1, line_no) AS line_id, length(text) AS n FROM l")
def line_registry(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("doc_id", "line_no", "line_id", F.length("text").cast("long").alias("n"))


@query("exact_duplicates", "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Texts are compared by a digest of 256 bits and their length, so that no text is shuffled."""
    rows = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("d"), F.length("text").alias("n_chars"), F.md5("text").alias("digest"))
    return rows.groupBy("d", "n_chars", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1").select("digest", "n", "first_id")


@query("repeated_lines", f"WITH {_L} SELECT md5(trim(text)) AS digest, count(*) AS n, count(DISTINCT doc_id) AS docs FROM l WHERE length(trim(text)) >= 12 GROUP BY 1 HAVING count(*) > 1")
def repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf).where(F.length(F.trim("text")) >= 12)
    return rows.groupBy(F.md5(F.trim("text")).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs")).where("n > 1")


_SHORT = "length(trim(text)) <= 60"


@query("heading_sections", f"WITH {_L}, s AS (SELECT doc_id, line_no, text, sum(({_SHORT})::INT) OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS section FROM l) SELECT doc_id, section, count(*) AS lines, min(line_no) AS first_line, sum(length(text))::BIGINT AS chars FROM s GROUP BY ALL")
def heading_sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines.sections(_lines(spark, sf), ["doc_id"], F.length(F.trim("text")) <= 60)
    return rows.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("lines"), F.min("line_no").alias("first_line"), F.sum(F.length("text").cast("long")).alias("chars"))


def _headed(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with a heading mark of a level told by their length."""
    level = F.when(F.length("text") <= 40, 1 + F.col("line_no") % 3)
    return _lines(spark, sf).withColumn("text", F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.trim("text"))).otherwise(F.col("text")))


@query(
    "heading_tree",
    f"""WITH {_L}, h AS (SELECT doc_id, line_no, CASE WHEN length(text) <= 40 THEN 1 + line_no % 3 END AS level FROM l), n AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS node FROM h),
    k AS (SELECT doc_id, node, level FROM n WHERE level IS NOT NULL)
    SELECT n.doc_id, n.line_no, n.level::INT AS level, n.node, coalesce((SELECT max(k.node) FROM k WHERE k.doc_id = n.doc_id AND k.node <= n.node AND (n.level IS NULL OR (k.level < n.level AND k.node < n.node))), 0)::INT AS parent FROM n""",
)
def heading_tree(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines.heading_paths(_headed(spark, sf), ["doc_id"])
    return rows.select("doc_id", "line_no", F.col("level").cast("int").alias("level"), "node", F.when(F.col("level").isNull(), F.col("node")).otherwise(F.col("parent")).alias("parent"))


@query(
    "structural_chunks",
    f"""WITH RECURSIVE {_L}, h AS (SELECT doc_id, line_no, trim(text) AS title, text, CASE WHEN length(text) <= 40 THEN 1 + line_no % 3 END AS level FROM l),
    n AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS node FROM h), k AS (SELECT doc_id, node, level, title FROM n WHERE level IS NOT NULL),
    up AS (SELECT a.doc_id, a.node, string_agg(b.title, ' > ' ORDER BY b.node) AS path FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.node <= a.node AND NOT EXISTS (SELECT 1 FROM k c WHERE c.doc_id = a.doc_id AND c.node > b.node AND c.node <= a.node AND c.level <= b.level) GROUP BY ALL),
    u AS (SELECT doc_id, node, line_no, text, unnest(range(0, greatest(1, length(text)), 4000)) AS a FROM n WHERE level IS NULL),
    c AS (SELECT doc_id, node, substr(text, (a + 1)::INT, 4000) AS piece, row_number() OVER (PARTITION BY doc_id, node ORDER BY line_no, a) AS k FROM u),
    r AS (SELECT doc_id, node, k, 1 AS part, length(piece) AS size FROM c WHERE k = 1
      UNION ALL SELECT c.doc_id, c.node, c.k, CASE WHEN r.size + 1 + length(c.piece) <= 4000 THEN r.part ELSE r.part + 1 END, CASE WHEN r.size + 1 + length(c.piece) <= 4000 THEN r.size + 1 + length(c.piece) ELSE length(c.piece) END FROM r JOIN c ON c.doc_id = r.doc_id AND c.node = r.node AND c.k = r.k + 1),
    t AS (SELECT r.doc_id, r.node, r.part, string_agg(c.piece, chr(10) ORDER BY r.k) AS body FROM r JOIN c ON c.doc_id = r.doc_id AND c.node = r.node AND c.k = r.k GROUP BY ALL)
    SELECT t.doc_id, t.node, t.part::INT AS part, 'shc_' || substr(sha256(t.doc_id || chr(31) || t.node || chr(31) || t.part || chr(31) || sha256(body)), 1, 24) AS chunk_id, (length(body) + coalesce(length(path) + 1, 0))::INT AS n FROM t LEFT JOIN up ON up.doc_id = t.doc_id AND up.node = t.node""",
)
def structural_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of heading nodes, packed to chunks with content-addressed ids."""
    rows = lines.heading_paths(_headed(spark, sf), ["doc_id"]).where("level IS NULL")
    bodies = rows.groupBy("doc_id", "node").agg(F.max("path").alias("path"), F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("lines"))
    return chunks.structural(bodies, "doc_id").select("doc_id", "node", "part", "chunk_id", F.length("text").alias("n"))


@query("html_table_shapes", r"SELECT page_id, len(regexp_extract_all(lower(html), '<tr\b'))::INT AS n_rows, len(regexp_extract_all(lower(html), '<t[dh]\b'))::INT AS n_cells, len(regexp_extract_all(lower(html), '<table\b'))::INT AS n_tables FROM pages")
def html_table_shapes(spark: SparkSession, sf: str) -> DataFrame:
    many = lambda p: F.regexp_count("html", F.lit(p))
    return read(spark, sf, "pages").select("page_id", markup.html_table_shape(F.col("html"))["rows"].alias("n_rows"), many(r"(?i)<t[dh]\b").alias("n_cells"), many(r"(?i)<table\b").alias("n_tables"))


@query(
    "strip_markup",
    r"WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g'), '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages), u AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS t FROM t) SELECT page_id, length(regexp_replace(t, '[#*_`>|~\-\s\x{A0}\x{0B}]+', '', 'g'))::INT AS n FROM u".replace('\\"', '"'),
)
def strip_markup(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", F.length(text.strip_markup(F.col("html"))).alias("n"))


@query(
    "markdown_table_islands",
    f"""WITH {_L}, p AS (SELECT *, contains(text, '|') AS piped FROM l), c AS (SELECT *, (piped AND (NOT coalesce(lag(piped) OVER w, false) OR line_no <> lag(line_no) OVER w + 1))::INT AS opens FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    i AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS tbl FROM c), k AS (SELECT *, [trim(x) FOR x IN string_split(regexp_replace(trim(text), '^\\|+|\\|+$', '', 'g'), '|')] AS cells FROM i WHERE piped),
    r AS (SELECT *, len([x FOR x IN cells IF NOT regexp_full_match(x, ':?-{{3,}}:?')]) = 0 AS ruled FROM k)
    SELECT doc_id, tbl AS "table", min(line_no) AS first_line, (count(*) FILTER (WHERE NOT ruled))::INT AS rows, (max(len(cells)) FILTER (WHERE NOT ruled))::INT AS columns, bool_or(ruled) AS ruled FROM r GROUP BY doc_id, tbl HAVING count(*) FILTER (WHERE NOT ruled) > 0""",
)
def markdown_table_islands(spark: SparkSession, sf: str) -> DataFrame:
    return lines.table_islands(_lines(spark, sf), ["doc_id"])


@query("fixed_window_chunks", "SELECT doc_id, s::INT AS start, md5(substr(text, (s + 1)::INT, 1600)) AS digest FROM (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 1600) / 1440))::BIGINT * 1440 + 1, 1440)) AS s FROM documents WHERE length(text) > 0)")
def fixed_window_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.windows(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "start", F.md5("window").alias("digest"))


@query(
    "greedy_pack_chunks",
    """WITH RECURSIVE a AS (SELECT doc_id, [x FOR x IN string_split(text, chr(10)) IF trim(x) <> ''] AS its FROM documents),
    u AS (SELECT doc_id, unnest(its) AS line, generate_subscripts(its, 1) - 1 AS i FROM a),
    p AS (SELECT doc_id, i, start, least(6000, length(line) - start) AS size FROM (SELECT *, unnest(range(0, greatest(1, length(line)), 6000)) AS start FROM u)),
    c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, start) AS k FROM p),
    r AS (SELECT doc_id, k, i, 0 AS pack, size, size AS total FROM c WHERE k = 1
      UNION ALL SELECT c.doc_id, c.k, c.i, CASE WHEN r.total + 1 + c.size <= 6000 THEN r.pack ELSE r.pack + 1 END, c.size, CASE WHEN r.total + 1 + c.size <= 6000 THEN r.total + 1 + c.size ELSE c.size END FROM r JOIN c ON c.doc_id = r.doc_id AND c.k = r.k + 1)
    SELECT doc_id, pack::INT AS pack, min(i)::INT AS first, max(i)::INT AS last, (sum(size) + count(*) - 1)::INT AS n FROM r GROUP BY doc_id, pack""",
)
def greedy_pack_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return chunks.packs(docs, "doc_id", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), chunks.PAGE, "\n").select("doc_id", "pack", "first", "last", F.length("text").alias("n"))


@query(
    "child_chunks",
    r"""WITH RECURSIVE u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k, t FROM (SELECT doc_id, unnest(its) AS t, generate_subscripts(its, 1) AS n FROM (SELECT doc_id, [regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '\S')] AS its FROM documents))),
    r AS (SELECT doc_id, 0::BIGINT AS k, '' AS pack, []::VARCHAR[] AS out FROM documents
      UNION ALL SELECT doc_id, k, CASE WHEN length(next) >= 1600 THEN '' ELSE next END, list_concat(ended, CASE WHEN length(next) >= 1600 THEN [trim(next)] ELSE [] END) FROM (
        SELECT u.doc_id, u.k,
          CASE WHEN length(t) > 1600 THEN '' WHEN pack = '' THEN t WHEN length(pack) + 2 + length(t) <= 1600 THEN pack || chr(10) || chr(10) || t
            ELSE (CASE WHEN ltrim(right(trim(pack), greatest(0, least(160, 1598 - length(t)))::INT), chr(10) || ' ') <> '' THEN ltrim(right(trim(pack), greatest(0, least(160, 1598 - length(t)))::INT), chr(10) || ' ') || chr(10) || chr(10) ELSE '' END) || t END AS next,
          CASE WHEN length(t) > 1600 THEN list_concat(CASE WHEN pack <> '' THEN [trim(pack)] ELSE [] END, [x FOR x IN [trim(substr(t, a + 1, 1600)) FOR a IN range(0, greatest(1, length(t) - 160), 1440)] IF x <> ''])
            WHEN pack <> '' AND length(pack) + 2 + length(t) > 1600 THEN [trim(pack)] ELSE [] END AS ended
        FROM r JOIN u ON u.doc_id = r.doc_id AND u.k = r.k + 1)),
    l AS (SELECT r.doc_id, max(r.k) AS k FROM r GROUP BY 1),
    w AS (SELECT doc_id, k, unnest(out) AS t, generate_subscripts(out, 1) AS n FROM r UNION ALL SELECT r.doc_id, r.k + 1, trim(pack), 1 FROM r JOIN l USING (doc_id, k) WHERE pack <> '')
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, n) - 1)::INT AS part, false AS atomic, length(t)::INT AS n, md5(t) AS digest FROM w""",
)
def child_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines play the paragraphs: the driver's texts have no blank lines."""
    docs = read(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunks.children(docs, "doc_id").select("doc_id", "part", "atomic", F.length("text").alias("n"), F.md5("text").alias("digest"))


def _needles(spark: SparkSession, sf: str) -> DataFrame:
    """The longest and the first word of each document's first line."""
    first = _lines(spark, sf).where("line_no = 1").select("doc_id", F.split(F.trim("text"), " +").alias("w"))
    return first.select("doc_id", F.lit(1).alias("label"), F.explode(F.array_distinct(F.array(F.get("w", F.lit(0)), F.get("w", F.lit(1)), F.get("w", F.lit(2))))).alias("needle")).where("needle IS NOT NULL")


@query(
    "label_window_neighbours",
    f"""WITH {_L}, f AS (SELECT doc_id, regexp_split_to_array(trim(text), ' +') AS w FROM l WHERE line_no = 1), d AS (SELECT DISTINCT doc_id, unnest(w[1:3]) AS needle FROM f),
    s AS (SELECT d.doc_id, line_no, count(*) FILTER (WHERE contains(text, needle)) AS score FROM d JOIN l USING (doc_id) GROUP BY ALL), b AS (SELECT doc_id, max(score) AS score FROM s GROUP BY 1), t AS (SELECT s.doc_id, b.score, min(line_no) AS line_no, count(*) AS n FROM s JOIN b ON s.doc_id = b.doc_id AND s.score = b.score GROUP BY ALL)
    , w AS (SELECT doc_id, line_no, text, lag(text) OVER v AS before, lead(text) OVER v AS after FROM l WINDOW v AS (PARTITION BY doc_id ORDER BY line_no)),
    h AS (SELECT w.*, CASE WHEN length(before) + length(text) + 2 <= 3000 THEN before || chr(10) || chr(10) || text ELSE text END AS head FROM w JOIN t USING (doc_id, line_no) WHERE t.n = 1 AND t.score > 0)
    SELECT doc_id, line_no, length(CASE WHEN length(head) + length(after) + 2 <= 3000 THEN head || chr(10) || chr(10) || after ELSE head END) AS n FROM h""",
)
def label_window_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    paragraphs = _lines(spark, sf)
    best = lines.best_paragraph(paragraphs, _needles(spark, sf), ["doc_id"], "label", "line_no").where("state = 'mapped'")
    return lines.with_neighbours(best.select("doc_id", "line_no"), paragraphs, ["doc_id"], "line_no", chunks.BENEFIT).select("doc_id", "line_no", F.length("window").cast("long").alias("n"))


@query("nearest_siblings", "SELECT a.source, a.doc_id, b.doc_id AS neighbour, row_number() OVER (PARTITION BY a.doc_id ORDER BY abs(b.n_chars - a.n_chars), b.n_chars, b.doc_id)::INT AS n FROM documents a JOIN documents b ON a.source = b.source AND a.doc_id <> b.doc_id QUALIFY n <= 3")
def nearest_siblings(spark: SparkSession, sf: str) -> DataFrame:
    return lines.nearest(read(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 3)


@query("chunk_ids_sha256", "SELECT doc_id, 'chi_' || substr(sha256(concat_ws(chr(31), doc_id::VARCHAR, source, text)), 1, 24) AS chunk_id FROM documents")
def chunk_ids_sha256(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", chunks.stable_id("chi_", F.col("doc_id").cast("string"), F.col("source"), F.col("text")).alias("chunk_id"))


@query("hex_terms", "SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, 't' || lower(hex(unnest(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z]+')))) AS term FROM documents) GROUP BY term")
def hex_terms(spark: SparkSession, sf: str) -> DataFrame:
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[0-9a-z]+"), F.lit(0)))
    return read(spark, sf, "documents").select(F.explode(tokens).alias("t")).select(text.opaque_term(F.col("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(
    "corpus_fingerprint",
    """WITH r AS (SELECT substr(md5(doc_id::VARCHAR), 1, 4) AS leaf, doc_id::VARCHAR AS k, sha256(concat_ws(chr(31), coalesce(source, chr(0)), coalesce(lang, chr(0)), coalesce(text, chr(0)))) AS d FROM documents),
    l AS (SELECT leaf, sha256(string_agg(d, '' ORDER BY k, d)) AS d FROM r GROUP BY leaf),
    b AS (SELECT substr(leaf, 1, 2) AS branch, sha256(string_agg(d, '' ORDER BY leaf)) AS d FROM l GROUP BY 1)
    SELECT sha256(string_agg(d, '' ORDER BY branch)) AS fingerprint FROM b""",
)
def corpus_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    told = F.concat_ws("\u001f", *(F.coalesce(c, F.lit("\u0000")) for c in ("source", "lang", "text")))
    return lineage.fingerprint(read(spark, sf, "documents"), "doc_id", told)


@query("marked_pages", "SELECT conv_id, turn AS page, length(trim(text)) AS n FROM conversations")
def marked_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Turns written as one marked text for each conversation and cut into pages again."""
    marked = F.concat(F.lit("[page "), F.col("turn").cast("string"), F.lit("]\n"), F.regexp_replace("text", r"(?mi)^\[page", "[-page"))
    whole = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", marked.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    pages = whole.select("conv_id", F.explode(markup.marked_pages(F.col("text"), "plain")).alias("p"))
    return pages.select("conv_id", F.col("p.page").cast("long").alias("page"), F.length(F.trim("p.text")).cast("long").alias("n"))


@query("page_labels", "SELECT doc_id, CASE WHEN n_chars // 2000 = n_chars // 1500 THEN 'p.' || (n_chars // 2000) ELSE 'pp.' || (n_chars // 2000) || '-' || (n_chars // 1500) END AS label, greatest(1, ceil(length(text) / 2))::INT AS tokens FROM documents")
def page_labels(spark: SparkSession, sf: str) -> DataFrame:
    start, end = F.floor(F.col("n_chars") / 2000), F.floor(F.col("n_chars") / 1500)
    return read(spark, sf, "documents").select("doc_id", text.page_label(start, end).alias("label"), text.approximate_tokens(F.col("text")).alias("tokens"))


_TOP = "(?m)^(It|The|Die|Der|La|Le|De|El) "


@query(
    "assembled_chunks",
    rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(text, '{_TOP}', '# \1 ', 'g') AS text FROM documents WHERE length(text) > 0),
    a AS (SELECT doc_id, length(text) AS whole, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM d),
    l AS (SELECT doc_id, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS lo, whole FROM a),
    m AS (SELECT doc_id, line, lo, least(lo + length(line) + 1, whole)::INT AS hi, regexp_matches(line, '^#{{1,6}}\s+.*\S') AS head FROM l WHERE lo < whole),
    s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY lo) AS section FROM m),
    g AS (SELECT doc_id, section, min(lo) AS lo, max(hi) AS hi, max(CASE WHEN head THEN regexp_extract(line, '^#{{1,6}}\s+(.+?)\s*$', 1) END) AS title FROM s GROUP BY ALL),
    q AS (SELECT doc_id, section, lo + x AS lo, least(hi, lo + x + 4000)::INT AS hi FROM (SELECT *, unnest(range(0, greatest(1, hi - lo), 4000)) AS x FROM s)),
    c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY lo) AS k FROM q),
    r AS (SELECT doc_id, section, k, lo AS first, hi FROM c WHERE k = 1 UNION ALL SELECT c.doc_id, c.section, c.k, CASE WHEN c.hi - r.first <= 4000 THEN r.first ELSE c.lo END, c.hi FROM r JOIN c ON c.doc_id = r.doc_id AND c.section = r.section AND c.k = r.k + 1),
    f AS (SELECT doc_id, section, first AS lo, max(hi) AS hi FROM r GROUP BY ALL),
    p AS (SELECT doc_id, text, sha256(text) AS digest FROM d),
    t AS (SELECT g.*, p.digest AS parent, sha256(substr(p.text, lo + 1, hi - lo)) AS digest, p.text FROM g JOIN p USING (doc_id)),
    v AS (SELECT f.doc_id, f.lo, f.hi, t.title, t.digest AS parent, sha256(t.parent || chr(31) || t.digest) AS above, sha256(substr(t.text, (f.lo + 1)::INT, (f.hi - f.lo)::INT)) AS digest FROM f JOIN t ON t.doc_id = f.doc_id AND t.section = f.section)
    SELECT doc_id::VARCHAR AS document, 'page' AS level, 0 AS "start", length(text)::INT AS "end", NULL AS title, NULL AS parent_digest, digest, digest AS link FROM p
    UNION ALL SELECT doc_id::VARCHAR, 'section', lo, hi, title, parent, digest, sha256(parent || chr(31) || digest) FROM t
    UNION ALL SELECT doc_id::VARCHAR, 'leaf', lo, hi, title, parent, digest, sha256(above || chr(31) || digest) FROM v""",
)
def assembled_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that begin with an article play the headings."""
    pages = read(spark, sf, "documents").select(F.col("doc_id").alias("document"), F.lit(1).alias("page"), F.regexp_replace("text", _TOP, "# $1 ").alias("text"))
    return assembly.assembled(pages).select("document", "level", "start", "end", "title", "parent_digest", "digest", "link")
