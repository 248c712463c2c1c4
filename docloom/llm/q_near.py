"""op10: documents linked by the Jaccard similarity of three-word shingles, 0.9 or more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.ngram_join import similar_documents


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_documents(docs, words=3, p=90, q=100)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')] ELSE list_distinct([t[i] || ' ' || t[i+1] || ' ' || t[i+2] FOR i IN range(1, len(t) - 1)]) END AS sh FROM w),
f AS (SELECT doc_id, len(sh) AS n, unnest([md5(x) FOR x IN sh]) AS h FROM s),
c AS (SELECT h, count(*) AS k FROM f GROUP BY h HAVING count(*) > 1),
o AS (SELECT f.*, coalesce(c.k, 1) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(c.k, 1), f.h) AS place FROM f LEFT JOIN c ON f.h = c.h),
p AS (SELECT * FROM o WHERE k > 1 AND place <= n - (90 * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn FROM p a JOIN p b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
l AS (SELECT cand.a, cand.b FROM cand JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 190 * len(list_intersect(x.sh, y.sh)) >= 90 * (an + bn)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, m.c AS component_id FROM s JOIN (SELECT node, min(c) AS c FROM r GROUP BY node) m ON m.node = s.doc_id
"""
QUERIES = {"op10_ngram_join": op10_ngram_join}
ORACLES = {"op10_ngram_join": SQL}
