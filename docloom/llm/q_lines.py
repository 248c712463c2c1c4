"""op4: later copies of repeated runs of two lines or more, and of single lines of 50 words or more, deleted from every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.line_dedup import dedup_lines

MIN_LINES, MIN_WORDS = 2, 50


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, MIN_LINES, min_words=MIN_WORDS).select("doc_id", "n_lines", "n_deleted", "n_runs", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


#: Maximal runs from the diagonals of equal lines: on a diagonal (two documents and a distance) adjacent places are one stretch.
SQL = r"""
WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE length(text) > 0),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS place FROM a WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
x AS (SELECT p.doc_id, p.place, q.doc_id AS earlier, p.place - q.place AS distance FROM l p JOIN l q ON p.line = q.line AND (q.doc_id < p.doc_id OR (q.doc_id = p.doc_id AND q.place < p.place))),
i AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id, earlier, distance ORDER BY place) AS stretch FROM x),
e AS (SELECT *, max(place) OVER (PARTITION BY doc_id, earlier, distance, stretch) - place + 1 AS shared FROM i),
s AS (SELECT doc_id, place, max(shared) AS shared FROM e GROUP BY doc_id, place),
r AS (SELECT s.*, shared >= 2 AND shared > coalesce(CASE WHEN lag(place) OVER w = place - 1 THEN lag(shared) OVER w - 1 END, 0) AS opens, coalesce(max(CASE WHEN shared >= 2 THEN place + shared END) OVER w > place, false) AS covered FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
g AS (SELECT l.doc_id, l.line_no, (opens OR NOT covered)::INT AS opens FROM r JOIN l USING (doc_id, place) WHERE covered OR len(regexp_extract_all(l.line, '[^\x20\x09-\x0D]+')) >= 50),
k AS (SELECT a.doc_id, count(*) AS n_lines, count(g.line_no) AS n_deleted, coalesce(sum(g.opens), 0) AS n_runs, coalesce(string_agg(a.line, chr(10) ORDER BY a.line_no) FILTER (WHERE g.line_no IS NULL), '') AS text FROM a LEFT JOIN g USING (doc_id, line_no) GROUP BY a.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_deleted, 0)::BIGINT AS n_deleted, coalesce(k.n_runs, 0)::BIGINT AS n_runs,
  CASE WHEN k.doc_id IS NULL THEN d.text ELSE k.text END AS text, sha256(coalesce(CASE WHEN k.doc_id IS NULL THEN d.text ELSE k.text END, '')) AS text_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""
QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLES = {"op4_line_dedup": SQL}
