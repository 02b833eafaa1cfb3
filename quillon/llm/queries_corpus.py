"""Queries of the operators that compare documents with one another: 1, 4, 5, 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, lines, pii, suffixes
from .tables import documents


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(documents(spark, sf_dir, "doc_id", "text"))
    kept = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"), F.length(kept).cast("long").alias("n_kept_chars"))


OP1_SQL = """
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
), line AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split
), win AS (
  SELECT doc_id, pos, line,
         CASE WHEN lead(line, 2) OVER d IS NOT NULL
              THEN line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d END AS w
  FROM line WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), dup AS (
  SELECT doc_id, pos, line,
         (w IS NOT NULL AND regexp_matches(w, '[^ \\t-\\r]')
          AND row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) > 1)::INT AS later
  FROM win
), cover AS (
  SELECT doc_id, pos, line, max(later) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS gone
  FROM dup
), kept AS (
  SELECT doc_id, count(*) AS n_lines, sum(gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (gone = 0), '') AS kept
  FROM cover GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256, length(coalesce(k.kept, ''))::BIGINT AS n_kept_chars
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(documents(spark, sf_dir, "doc_id", "text")).drop("text")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(documents(spark, sf_dir, "doc_id", "text"))


OP5_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id AS doc, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON r.doc = e.x
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.n, 0) AS n_similar, m.root AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, count(*) AS n FROM e GROUP BY 1) k USING (doc_id)
JOIN (SELECT doc AS doc_id, min(root) AS root FROM r GROUP BY 1) m USING (doc_id)
"""


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.dedup_substrings(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Texts as hexadecimal digits, in pieces of 1,000 bytes and the 49 after them, so that each 50-byte string is a short substring.
OP6_SQL = """
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), piece AS (
  SELECT doc_id, n, b, substr(h, (2000 * b + 1)::BIGINT, 2098) AS h FROM (SELECT doc_id, h, n, unnest(range(0, (n + 999) // 1000)) AS b FROM t)
), byte AS (
  SELECT doc_id, 1000 * b + k AS i, substr(h, 2 * k + 1, 2) AS x, CASE WHEN 1000 * b + k + 50 <= n THEN substr(h, 2 * k + 1, 100) END AS g
  FROM (SELECT *, unnest(range(0, least(1000, n - 1000 * b))) AS k FROM piece)
), first AS (
  SELECT g, min(doc_id) AS d FROM byte WHERE g IS NOT NULL GROUP BY 1
), mark AS (
  SELECT byte.doc_id, i, x, coalesce(first.d < byte.doc_id, false) AS starts FROM byte LEFT JOIN first USING (g)
), gone AS (
  SELECT doc_id, i, x, max(starts::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM mark
), run AS (
  SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS begins FROM gone
), made AS (
  SELECT doc_id, sum(gone)::BIGINT AS n_removed, count_if(begins)::BIGINT AS n_spans, coalesce(string_agg(x, '' ORDER BY i) FILTER (gone = 0), '') AS kept FROM run GROUP BY 1
)
SELECT t.doc_id, t.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM t LEFT JOIN made USING (doc_id)
"""
