"""Registered queries of the document engine over the driver's tables, each with DuckDB SQL where SQL can say it.

The tables hold no legal documents, so line queries derive lines from ``documents``:
each text is split at line feeds and some lines get an article or a heading in
front, by their number.  Everything covers whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import providers
from ..functions import patterns as P
from ..functions import text as X
from ..functions import vectors as V
from ..operators import articles, chunks, lines, questions, search, tables
from ..sources import files
from ..streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts by id, on all cores: rules over whole texts are the work here, not the reading."""
    return files.spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


# search -------------------------------------------------------------------------

Q0 = "(SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"
HITS = f"SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q.v) AS s FROM embeddings, {Q0} q"
LABEL = "CASE WHEN s >= 0.6 THEN 'very-close' WHEN s >= 0.45 THEN 'close' WHEN s >= 0.3 THEN 'moderate' ELSE 'weak' END"


def vector0(spark: SparkSession, d: str) -> list[float]:
    row = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0])


def hits(spark: SparkSession, d: str) -> DataFrame:
    return search.scored(table(spark, d, "embeddings"), vector0(spark, d))


@query(f"SELECT vec_id, label, round(s, 6) AS similarity, {LABEL} AS closeness_label FROM ({HITS}) WHERE s >= 0.2 ORDER BY s DESC, vec_id LIMIT 5")
def search_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five best of all vectors for vector 0, at 0.2 or more."""
    found = search.search(table(spark, d, "embeddings"), vector0(spark, d), 5, 0.2, ["vec_id"])
    return found.select("vec_id", "label", F.round("similarity", 6).alias("similarity"), "closeness_label")


@query(f"SELECT vec_id, round(s, 6) AS similarity FROM ({HITS}) WHERE s >= 0.0")
def search_threshold(spark: SparkSession, d: str) -> DataFrame:
    """P9 over the whole corpus."""
    return search.above(hits(spark, d), 0.0).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT {LABEL} AS closeness_label, count(*) AS n, round(max(s), 6) AS best FROM ({HITS}) GROUP BY 1")
def search_labels(spark: SparkSession, d: str) -> DataFrame:
    """F26 over all hits."""
    return hits(spark, d).groupBy(X.closeness("similarity").alias("closeness_label")).agg(F.count("*").alias("n"), F.round(F.max("similarity"), 6).alias("best"))


@query(f"SELECT f.name AS close_filter, f.t AS threshold, count(s) AS n FROM (VALUES ('off', 0.0::DOUBLE), ('loose', 0.2::DOUBLE), ('balanced', 0.35::DOUBLE), ('strict', 0.5::DOUBLE)) f(name, t) LEFT JOIN ({HITS}) ON s >= f.t GROUP BY 1, 2")
def search_close_filter(spark: SparkSession, d: str) -> DataFrame:
    """Hits at each close filter, in one pass."""
    s = hits(spark, d).where(~F.isnan("similarity")).agg(*(F.count_if(F.col("similarity") >= t).alias(name) for name, t in X.CLOSE_FILTERS.items()))
    rows = s.select(F.explode(F.array(*(F.struct(F.lit(name).alias("close_filter"), F.col(name).alias("n")) for name in X.CLOSE_FILTERS))).alias("r"))
    return rows.select("r.close_filter", X.close_threshold("r.close_filter").cast("double").alias("threshold"), "r.n")


@query("""
WITH p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s
  FROM embeddings q JOIN embeddings c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM p)
SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 3""")
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest of all vectors for every vector whose id 20 divides."""
    e = table(spark, d, "embeddings")
    found = search.nearest(e, e.where("vec_id % 20 = 0"), 3, same=True)
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH h AS (SELECT vec_id, s, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM ({HITS}) WHERE s >= 0.35),
k AS (SELECT h.*, regexp_replace(p.url, '^https?://[^/]*/', '') AS path FROM h LEFT JOIN pages p ON p.page_id = h.vec_id WHERE rank <= 5)
SELECT 'vector 0' AS query, 0.35::DOUBLE AS effective_threshold, round(coalesce(max(s), 0), 6) AS top_similarity, count(*) AS result_count,
       string_agg(rank || ':' || vec_id || ':' || coalesce(string_split(path, '/')[-1], ''), ',' ORDER BY rank) AS hits FROM k""")
def response_shape(spark: SparkSession, d: str) -> DataFrame:
    """The response for vector 0 at the balanced filter."""
    found = search.search(table(spark, d, "embeddings"), vector0(spark, d), 5, 0.35, ["vec_id"])
    pages = table(spark, d, "pages").select(F.col("page_id").alias("vec_id"), F.regexp_replace("url", "^https?://[^/]*/", "/").alias("p"))
    named = search.ranked(found, ["vec_id"]).join(pages, "vec_id", "left").withColumn("path", F.coalesce(X.relative_path("p"), F.lit("")))
    out = search.response(named, "vector 0", "none", 5, 0.0, "balanced", "embeddings", ["vec_id", "path"])
    shown = F.array_join(F.transform("results", lambda r: F.concat_ws(":", r["rank"], r["vec_id"], r["path"])), ",")
    return out.select("query", "effective_threshold", F.round("top_similarity", 6).alias("top_similarity"), "result_count", shown.alias("hits"))


# sentences and chunks --------------------------------------------------------------

SENTENCES = r"""
SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?;:])\s+', '\1' || chr(1), 'g'), chr(1)),
  lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')) AS sentence FROM documents"""


@query(f"SELECT doc_id, sentence, count(*) AS n FROM ({SENTENCES}) GROUP BY 1, 2")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """every sentence of every text, and how often the text has it."""
    split = texts(spark, d).select("doc_id", F.explode_outer(X.sentences("text")).alias("sentence")).where("sentence is not null")
    return split.groupBy("doc_id", "sentence").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, count(*) AS n_sentences, sum(length(sentence))::BIGINT AS n_chars, max(length(sentence))::BIGINT AS longest FROM ({SENTENCES}) GROUP BY 1")
def sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    """F24 without exploding: sentences, characters and the longest, per text."""
    s = texts(spark, d).where(X.has_text("text")).select("doc_id", F.transform(X.sentences("text"), F.length).alias("n"))
    return s.select("doc_id", F.size("n").cast("long").alias("n_sentences"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_chars"), F.array_max("n").cast("long").alias("longest"))


@query(r"""
WITH RECURSIVE t AS (
  SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT doc_id, 1 AS pos, clean AS rest, CAST(NULL AS VARCHAR) AS piece FROM t
  UNION ALL
  SELECT doc_id, pos + (piece IS NOT NULL)::INT,
         CASE WHEN length(rest) <= 300 THEN NULL ELSE ltrim(substr(rest, cut + 1)) END,
         CASE WHEN length(rest) <= 300 THEN rest ELSE rtrim(substr(rest, 1, cut)) END
  FROM (SELECT *, CASE WHEN contains(substr(rest, 1, 301), ' ') AND 301 - instr(reverse(substr(rest, 1, 301)), ' ') >= 150
                       THEN 301 - instr(reverse(substr(rest, 1, 301)), ' ') ELSE 300 END AS cut FROM w WHERE rest IS NOT NULL)
)
SELECT doc_id, pos::BIGINT AS pos, piece FROM w WHERE piece IS NOT NULL AND (piece <> '' OR pos = 1)""")
def long_split(spark: SparkSession, d: str) -> DataFrame:
    """every whole text as one long sentence, in pieces of 300 characters at most."""
    docs = texts(spark, d).where("text is not null")
    return docs.select("doc_id", F.posexplode_outer(X.long_pieces("text", 300)).alias("p", "piece")).where("piece is not null").select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), "piece")


PIECES = rf"""
u AS (
  SELECT doc_id, unnest(parts) AS sentence, unnest(range(len(parts))) AS k
  FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(replace(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(10), ' '), '([.!?;:])\s+', '\1' || chr(1), 'g'), chr(1)),
    lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM documents)
), w AS (
  SELECT doc_id, k, 1 AS j, sentence AS rest, CAST(NULL AS VARCHAR) AS piece FROM u WHERE length(sentence) > 1400
  UNION ALL
  SELECT doc_id, k, j + (piece IS NOT NULL)::INT, CASE WHEN length(rest) <= 1400 THEN NULL ELSE ltrim(substr(rest, cut + 1)) END,
         CASE WHEN length(rest) <= 1400 THEN rest ELSE rtrim(substr(rest, 1, cut)) END
  FROM (SELECT *, CASE WHEN contains(substr(rest, 1, 1401), ' ') AND 1401 - instr(reverse(substr(rest, 1, 1401)), ' ') >= 700
                       THEN 1401 - instr(reverse(substr(rest, 1, 1401)), ' ') ELSE 1400 END AS cut FROM w WHERE rest IS NOT NULL)
), parts AS (
  SELECT doc_id, k, 0 AS j, sentence AS piece FROM u WHERE length(sentence) <= 1400
  UNION ALL SELECT doc_id, k, j, piece FROM w WHERE piece IS NOT NULL AND piece <> ''
), lists AS (SELECT doc_id, list(piece ORDER BY k, j) AS ps FROM parts GROUP BY 1)"""


@query(f"""
WITH RECURSIVE {PIECES},
packed AS (
  SELECT doc_id, list_reduce(list_transform(ps, lambda x: [x]), lambda a, x: CASE WHEN length(a[len(a)]) + 1 + length(x[1]) > 1400 THEN list_concat(a, x)
         ELSE list_concat(a[1:len(a) - 1], [a[len(a)] || ' ' || x[1]]) END) AS cs FROM lists
)
SELECT doc_id, format('{{}}_{{:03d}}', doc_id, i) AS chunk_id, i::INT AS chunk_index, len(cs)::INT AS chunk_count, cs[i] AS content
FROM (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM packed)""")
def pack_chunks_len(spark: SparkSession, d: str) -> DataFrame:
    """V8 by length alone, V9."""
    packed = chunks.pack_by_length(texts(spark, d), "text")
    return chunks.records(packed.drop("text").withColumn("article_number", F.col("doc_id").cast("string"))).select("doc_id", "chunk_id", "chunk_index", "chunk_count", "content")


@query(f"""
WITH RECURSIVE {PIECES},
place AS (
  SELECT doc_id, k, j, piece, list_transform(list_filter(string_split(lower(piece), ' '), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 64) AS p FROM parts
), counted AS (
  SELECT doc_id, k, j, piece, list_transform(range(0, 64), lambda b: len(list_filter(p, lambda q: q = b))::DOUBLE) AS c FROM place
), scaled AS (
  SELECT doc_id, k, j, piece, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS z FROM counted
), items AS (
  SELECT doc_id, list({{'cs': [piece], 'v': list_transform(c, lambda x: x / z)}} ORDER BY k, j) AS ps FROM scaled GROUP BY 1
), packed AS (
  SELECT doc_id, list_reduce(ps, lambda a, x:
    CASE WHEN length(a.cs[len(a.cs)]) + 1 + length(x.cs[1]) > 1400 OR length(a.cs[len(a.cs)]) >= 900 AND list_cosine_similarity(a.v, x.v) < 0.72
         THEN {{'cs': list_concat(a.cs, x.cs), 'v': x.v}}
         ELSE {{'cs': list_concat(a.cs[1:len(a.cs) - 1], [a.cs[len(a.cs)] || ' ' || x.cs[1]]), 'v': list_transform(list_zip(a.v, x.v), lambda y: (y[1] + y[2]) / 2)}} END).cs AS cs FROM items
)
SELECT doc_id, format('{{}}_{{:03d}}', doc_id, i) AS chunk_id, i::INT AS chunk_index, len(cs)::INT AS chunk_count, cs[i] AS content
FROM (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM packed)""")
def pack_chunks_vec(spark: SparkSession, d: str) -> DataFrame:
    """V8, V7 with the stand-in's vectors, V9."""
    files.small_batches(spark)
    docs = texts(spark, d)
    packed = chunks.pack_by_meaning(docs, providers.embed_arrays(providers.HashingEmbedder()), "text")
    return chunks.records(packed.drop("text").withColumn("article_number", F.col("doc_id").cast("string"))).select("doc_id", "chunk_id", "chunk_index", "chunk_count", "content")


GROUPS = "SELECT doc_id, source, lang, source || '.json' AS file FROM documents"


@query("""
WITH g AS (SELECT *, min(doc_id) OVER (PARTITION BY lang, third) AS first FROM (SELECT doc_id, lang, ('0x' || substr(md5(coalesce(source, '')), 1, 8))::BIGINT % 3 AS third FROM documents))
SELECT doc_id, dense_rank() OVER (PARTITION BY lang ORDER BY first)::BIGINT AS group_id,
       row_number() OVER (PARTITION BY lang, third ORDER BY doc_id)::BIGINT AS chunk_index,
       count(*) OVER (PARTITION BY lang, third) AS chunk_count,
       format('{}_{:03d}_g{:03d}', third::VARCHAR, row_number() OVER (PARTITION BY lang, third ORDER BY doc_id), dense_rank() OVER (PARTITION BY lang ORDER BY first)) AS chunk_id
FROM g""")
def chunk_group_ids(spark: SparkSession, d: str) -> DataFrame:
    """A4, A5: documents as chunks, a language as a file, a third of the sources as the article."""
    third = F.conv(F.substring(F.md5(F.coalesce("source", F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % 3
    docs = table(spark, d, "documents").select("doc_id", "lang", third.cast("string").alias("article_number"))
    out = tables.number_chunks(docs, "lang", "doc_id")
    return out.select("doc_id", F.col("group_id").cast("long").alias("group_id"), F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_count", "chunk_id")


@query(r"""
WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '\s+[0-9]+\s*[\x{AD}–—-]?\s*$', ''), '\s+', ' ', 'g')) AS content FROM documents)
SELECT doc_id, content FROM c WHERE content <> '' AND NOT regexp_matches(content, '^\s*[0-9]+\s*[\x{AD}–—-]*\s*$')""")
def clean_content(spark: SparkSession, d: str) -> DataFrame:
    """F21-F23 (the tables hold none of the markers and notes that SQL can't cut)."""
    # out of a generator: the filter would move below the exchange that puts texts on all cores and work out every content once more
    docs = texts(spark, d).select("doc_id", F.explode_outer(F.array(X.clean_chunk("text"))).alias("content"))
    return docs.where((F.col("content") != "") & ~X.is_footer_only("content"))


# ids and batches ---------------------------------------------------------------------


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS id FROM documents")
def assign_ids(spark: SparkSession, d: str) -> DataFrame:
    """A source as a file."""
    out = tables.assign_ids(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")
    return out.withColumn("id", F.col("id").cast("long"))


@query("SELECT source, 1 + (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5 AS batch_index, doc_id FROM documents")
def batches(spark: SparkSession, d: str) -> DataFrame:
    """Runs of five in each source."""
    out = tables.batches(table(spark, d, "documents").select("doc_id", "source"), 5, "doc_id", "source")
    return out.select("source", F.col("batch_index").cast("long").alias("batch_index"), "doc_id")


@query("SELECT doc_id, coalesce(nullif(nullif(doc_id::VARCHAR, ''), '0'), nullif(source, ''), 'index-' || doc_id) AS label FROM documents")
def record_labels(spark: SparkSession, d: str) -> DataFrame:
    """F38."""
    return table(spark, d, "documents").select("doc_id", X.record_label("doc_id", "source", "doc_id").alias("label"))


# lines ----------------------------------------------------------------------------------

SPLIT = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents WHERE text IS NOT NULL"
CLEAN = r"trim(regexp_replace(line, '\s+', ' ', 'g'))"
HEADING = rf"regexp_replace({CLEAN}, '([a-zA-ZÀ-ÖØ-öø-ÿ])([0-9]{{2,3}})$', '\1.\2')"
SIGNATURE = rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({HEADING}), '\d+', '#', 'g'), '[\s\-–—_]+', ' ', 'g'), '[^a-zà-öø-ÿ# ]+', '', 'g'))"
PSEUDO = f"""SELECT doc_id, n, CASE WHEN n % 36 = 0 THEN 'Livre ' || (n // 36 + 1) WHEN n % 12 = 0 THEN 'Titre ' || (n // 12 + 1) WHEN n % 12 = 1 THEN 'Chapitre ' || (n // 12 + 1)
 WHEN n % 12 = 6 THEN 'Section ' || (n // 12 + 1) || ' : ' || line WHEN n % 12 = 9 THEN 'Sous-section ' || (n // 12 + 1) || ' : ' || line WHEN n % 3 = 2 THEN 'Article ' || (n // 3 + 1) || ' ' || line ELSE line END AS line FROM ({SPLIT})"""


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = texts(spark, d).where("text is not null")
    return docs.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("n", "line"))


def pseudo_lines(spark: SparkSession, d: str) -> DataFrame:
    n, line = F.col("n"), F.col("line")
    twelfth = (F.floor(n / 12) + 1).cast("string")
    made = (
        F.when(n % 36 == 0, F.concat(F.lit("Livre "), (F.floor(n / 36) + 1).cast("string")))
        .when(n % 12 == 0, F.concat(F.lit("Titre "), twelfth))
        .when(n % 12 == 1, F.concat(F.lit("Chapitre "), twelfth))
        .when(n % 12 == 6, F.concat(F.lit("Section "), twelfth, F.lit(" : "), line))
        .when(n % 12 == 9, F.concat(F.lit("Sous-section "), twelfth, F.lit(" : "), line))
        .when(n % 3 == 2, F.concat(F.lit("Article "), (F.floor(n / 3) + 1).cast("string"), F.lit(" "), line))
        .otherwise(line)
    )
    return text_lines(spark, d).withColumn("line", made)


@query(f"SELECT doc_id, n::BIGINT AS n, {HEADING} AS heading FROM ({SPLIT})")
def normalise_heading(spark: SparkSession, d: str) -> DataFrame:
    """F1 of every line."""
    return text_lines(spark, d).select("doc_id", F.col("n").cast("long").alias("n"), X.normalise_heading("line").alias("heading"))


@query(f"SELECT {SIGNATURE} AS signature, count(*) AS n FROM ({SPLIT}) GROUP BY 1")
def margin_signature(spark: SparkSession, d: str) -> DataFrame:
    """F2 of every line, counted."""
    return text_lines(spark, d).groupBy(X.margin_signature("line").alias("signature")).agg(F.count("*").alias("n"))


@query(f"""
WITH s AS (SELECT doc_id, CASE WHEN n % 40 < 6 THEN 'top' WHEN n % 40 >= 35 THEN 'bottom' END AS zone, {SIGNATURE} AS signature FROM ({SPLIT}))
SELECT doc_id, zone, signature, count(*) AS times FROM s WHERE zone IS NOT NULL AND length(signature) >= 6 GROUP BY ALL HAVING count(*) >= 2""")
def recurring_lines(spark: SparkSession, d: str) -> DataFrame:
    """A3: pages of 40 lines, 100 high; margin lines that recur in a document."""
    found = lines.recurring(_laid_out(text_lines(spark, d)))
    return found.select(F.col("doc").alias("doc_id"), "zone", "signature", "times")


def _laid_out(rows: DataFrame) -> DataFrame:
    at = (F.col("n") % 40) * 2.5
    size = F.when(F.col("n") % 12 == 0, 14.0).when(F.col("n") % 40 >= 35, 8.0).otherwise(10.0)
    return rows.select(
        F.col("doc_id").alias("doc"), (F.floor(F.col("n") / 40) + 1).cast("int").alias("page"), F.col("n").alias("line_no"), F.col("line").alias("text"), size.alias("size"),
        F.array(F.when(F.col("n") % 7 == 0, "Body-Bold").otherwise("Body")).alias("fonts"), at.alias("y0"), (at + 2.0).alias("y1"), F.lit(100.0).alias("page_height"),
    )


@query(f"SELECT doc_id, median(CASE WHEN n % 12 = 0 THEN 14.0 WHEN n % 40 >= 35 THEN 8.0 ELSE 10.0 END)::DOUBLE AS body_size FROM ({SPLIT}) GROUP BY 1")
def body_sizes(spark: SparkSession, d: str) -> DataFrame:
    """A2."""
    return lines.body_sizes(_laid_out(text_lines(spark, d))).select(F.col("doc").alias("doc_id"), "body_size")


def _re2(pattern: str) -> str:
    """A pattern of the rules as a DuckDB literal."""
    return "'(?i)" + pattern.replace("'", "''") + "'"


@query(rf"""
WITH l AS (SELECT doc_id, n, {HEADING} AS t, {SIGNATURE} AS signature, CASE WHEN n % 40 < 6 THEN 'top' WHEN n % 40 >= 35 THEN 'bottom' END AS zone,
           CASE WHEN n % 12 = 0 THEN 14.0 WHEN n % 40 >= 35 THEN 8.0 ELSE 10.0 END AS size FROM ({PSEUDO})),
b AS (SELECT doc_id, median(size) AS body FROM l GROUP BY 1),
r AS (SELECT doc_id, zone, signature FROM l WHERE zone IS NOT NULL AND length(signature) >= 6 GROUP BY ALL HAVING count(*) >= 2),
m AS (SELECT l.*, b.body, r.signature IS NOT NULL AS again FROM l JOIN b USING (doc_id) LEFT JOIN r ON r.doc_id = l.doc_id AND r.zone = l.zone AND r.signature = l.signature)
SELECT doc_id, (n // 40 + 1)::INT AS page, n::INT AS line_no, t AS text FROM m
WHERE t <> '' AND NOT regexp_matches(t, {_re2(P.HEADER_FOOTER)})
  AND NOT (zone IS NOT NULL AND NOT (regexp_matches(t, {_re2(P.STRUCTURAL)}) AND size >= body)
           AND (again OR regexp_matches(t, {_re2(P.PAGE_NUMBER)}) OR (size <= body * 0.9 AND regexp_matches(t, {_re2(P.MARGIN_WORDS)}))))""")
def drop_margins(spark: SparkSession, d: str) -> DataFrame:
    """The lines that stay."""
    kept = lines.drop_margins(_laid_out(pseudo_lines(spark, d)))
    return kept.select(F.col("doc").alias("doc_id"), "page", "line_no", "text")


ROMAN = "(premier|[ivxlcdm]+|[0-9]+)"
LEVEL = rf"""CASE WHEN regexp_matches(t, '(?i)^\s*livre\b') THEN 'livre' WHEN regexp_matches(t, '(?i)^\s*titre\s+{ROMAN}\b') THEN 'titre'
 WHEN regexp_matches(t, '(?i)^\s*c?hapitre\s+(premier|[ivxlcdm]+[0-9]{{0,2}}|[0-9]+)\b(\s*[:：].*)?$') THEN 'chapitre'
 WHEN regexp_matches(t, '(?i)^\s*sous(\s*[‑–—-]\s*|\s+)section\b') THEN 'sous_section' WHEN regexp_matches(t, '(?i)^\s*section\b') THEN 'section' END"""


@query(f"SELECT doc_id, n::BIGINT AS n, {LEVEL} AS level FROM (SELECT doc_id, n, {HEADING} AS t FROM ({PSEUDO}))")
def line_classify(spark: SparkSession, d: str) -> DataFrame:
    """P2 of every line (of body size, so that size and weight decide nothing)."""
    rows = pseudo_lines(spark, d).select("doc_id", "n", X.normalise_heading("line").alias("text"), F.lit(10.0).alias("size"), F.array(F.lit("Body")).alias("fonts"), F.lit(10.0).alias("body_size"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), lines.level().alias("level"))


@query(rf"""
SELECT doc_id, n::BIGINT AS n, length(l) AS letters, length(l) >= 8 AND length(u) >= 0.75 * length(l) AS upper
FROM (SELECT doc_id, n, regexp_replace(t, '\P{{L}}', '', 'g') AS l, regexp_replace(t, '\P{{Lu}}', '', 'g') AS u FROM (SELECT doc_id, n, {HEADING} AS t FROM ({SPLIT})))""")
def upper_fragments(spark: SparkSession, d: str) -> DataFrame:
    """F6 of every line."""
    rows = text_lines(spark, d).withColumn("t", X.normalise_heading("line"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), F.length(F.regexp_replace("t", "\\P{L}", "")).cast("long").alias("letters"), X.is_upper_fragment("t").alias("upper"))


@query(rf"""
WITH t AS (SELECT doc_id, n, {HEADING} AS t FROM ({SPLIT})), m AS (SELECT doc_id, n, (n % 50) || ' - ' || t AS t FROM t),
b AS (SELECT doc_id, n, n % 50 AS number, trim(regexp_replace(t, '^\s*[0-9]+\s*[–—-]\s*', '')) AS body FROM m)
SELECT doc_id, n::BIGINT AS n, CASE WHEN number >= 30 THEN true WHEN body = '' OR regexp_matches(body, '(?i)^(l[''’]|(les?|la|du|des?)([^\pL\d_]|$))') THEN false
  WHEN regexp_matches(body, '(?i)(^|[^\pL\d_])(code|loi|d[ée]cret|bulletin\s+officiel|dahir|article)([^\pL\d_]|$)')
    OR regexp_matches(body, '(?i)^\s*(voir|les\s+dispositions|comparer|m[êe]me\s+remarque|ibid|a\s+comparer)([^\pL\d_]|$)') THEN true ELSE length(body) > 120 END AS note FROM b""")
def footnote_lines(spark: SparkSession, d: str) -> DataFrame:
    """every line with a number put in front."""
    numbered = F.concat((F.col("n") % 50).cast("string"), F.lit(" - "), X.normalise_heading("line"))
    rows = text_lines(spark, d).select("doc_id", F.col("n").cast("long").alias("n"), numbered.alias("line"))
    return rows.select("doc_id", "n", X.is_footnote("line").alias("note"))


_AT = ", ".join(f"max(CASE WHEN level = '{x}' THEN n END) OVER w AS at_{x}, last_value(CASE WHEN level = '{x}' THEN t END IGNORE NULLS) OVER w AS v_{x}" for x in articles.LEVELS)
_CARRIED = ", ".join(
    f"CASE WHEN at_{x} > greatest(-1, {', '.join(f'coalesce(at_{h}, -1)' for h in articles.LEVELS[:k]) or -1}) THEN v_{x} ELSE '' END AS {x}" for k, x in enumerate(articles.LEVELS)
)


@query(f"""
WITH l AS (SELECT doc_id, n, t, {LEVEL} AS level FROM (SELECT doc_id, n, {HEADING} AS t FROM ({PSEUDO}))),
p AS (SELECT doc_id, n, {_AT} FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n))
SELECT doc_id, n::BIGINT AS n, {_CARRIED} FROM p""")
def hierarchy_carry(spark: SparkSession, d: str) -> DataFrame:
    """The headings in force on every line, all five levels."""
    rows = pseudo_lines(spark, d).select("doc_id", "n", X.normalise_heading("line").alias("text"), F.lit(10.0).alias("size"), F.array(F.lit("Body")).alias("fonts"), F.lit(10.0).alias("body_size"))
    out = articles.carry_hierarchy(rows.withColumn("level", lines.level()), "doc_id", ("n",))
    return out.select("doc_id", F.col("n").cast("long").alias("n"), *articles.LEVELS)


@query(None)
def extract_articles(spark: SparkSession, d: str) -> DataFrame:
    """A1 and all it needs, from laid-out lines to articles."""
    rows = _laid_out(pseudo_lines(spark, d)).withColumn("doc", F.col("doc").cast("string"))
    return articles.extract(rows)


@query(f"SELECT doc_id, n // 3 AS part, CASE WHEN min(n // 40) = max(n // 40) THEN (min(n // 40) + 1)::VARCHAR ELSE (min(n // 40) + 1) || '-' || (max(n // 40) + 1) END AS pages FROM ({SPLIT}) GROUP BY 1, 2")
def page_span(spark: SparkSession, d: str) -> DataFrame:
    """Three lines as an article, 40 as a page."""
    rows = text_lines(spark, d).select("doc_id", F.floor(F.col("n") / 3).cast("long").alias("part"), (F.floor(F.col("n") / 40) + 1).alias("page"))
    return tables.spans_of_pages(rows, "doc_id", "part")


@query(f"SELECT doc_id, n::BIGINT AS n, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM ({SPLIT})")
def line_offsets(spark: SparkSession, d: str) -> DataFrame:
    """W7."""
    out = tables.offsets(text_lines(spark, d), "doc_id", "n", "line")
    return out.select("doc_id", F.col("n").cast("long").alias("n"), F.col("offset").cast("long").alias("offset"))


_NOTE_BODY = r"trim(regexp_replace(x, '^\s*[0-9]+\s*[–—-]\s*', ''))"
_IS_NOTE = rf"""(regexp_matches(x, '^\s*[0-9]+\s*[–—-]') AND CASE WHEN coalesce(try_cast(regexp_extract(x, '^\s*([0-9]+)\s*[–—-]', 1) AS BIGINT), 1000000000) >= 30 THEN true
  WHEN {_NOTE_BODY} = '' OR regexp_matches({_NOTE_BODY}, '(?i)^(l[''’]|(les?|la|du|des?)([^\pL\d_]|$))') THEN false
  WHEN regexp_matches({_NOTE_BODY}, '(?i)(^|[^\pL\d_])(code|loi|d[ée]cret|bulletin\s+officiel|dahir|article)([^\pL\d_]|$)')
    OR regexp_matches({_NOTE_BODY}, '(?i)^\s*(voir|les\s+dispositions|comparer|m[êe]me\s+remarque|ibid|a\s+comparer)([^\pL\d_]|$)') THEN true ELSE length({_NOTE_BODY}) > 120 END)"""
_WORD_AFTER = _re2(P.SUFFIX_WORD.replace("(?=", "(?:"))


def _cut(sql: str, patterns) -> str:
    for pattern in patterns:
        sql = f"string_split_regex({sql}, {_re2(pattern)})[1]"
    return sql


def _fits(cut: int) -> str:
    return f"(length(g1) >= 3 AND try_cast(left(g1, {cut}) AS INT) BETWEEN 1 AND 30 AND length(g1) - {cut} BETWEEN 2 AND 3)"


_SPLIT_AT = " ".join(f"WHEN {_fits(cut)} THEN {cut}" for cut in (2, 1, 3))


@query(rf"""
WITH l AS (
  SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda line: {HEADING}),
         lambda x: x <> '' AND NOT regexp_matches(x, {_re2(P.HEADER_FOOTER)}) AND NOT {_IS_NOTE}) AS kept FROM documents WHERE text IS NOT NULL
), c AS (
  SELECT doc_id, text, {_cut(f"regexp_replace(array_to_string(kept, chr(10)), {_re2(P.LEADING_SUB_TOKEN)}, '')", P.CUTS)} AS body FROM l
), n AS (
  SELECT doc_id, body, text, {HEADING.replace("(line,", "(text,")} AS one FROM c
), g AS (
  SELECT *, coalesce(nullif(regexp_extract(one, {_re2(P.ANNOTATION)}, 1), ''), regexp_extract(one, {_re2(P.ANNOTATION_UNOPENED)}, 1)) AS label,
         regexp_extract(text, {_re2(P.SUFFIX_NUMBER)}, 1) AS g1, regexp_extract(text, {_re2(P.SUFFIX_NUMBER)}, 2) AS g2, regexp_extract(text, {_re2(P.SUFFIX_NUMBER)}, 3) AS g3 FROM n
), k AS (
  SELECT *, CASE {_SPLIT_AT} ELSE 0 END AS cut FROM g
), m AS (
  SELECT *, try_cast(CASE WHEN cut > 0 THEN left(g1, cut) ELSE g1 END AS INT) AS number, CASE WHEN g3 <> '' THEN g3 WHEN cut > 0 THEN substr(g1, cut + 1) ELSE '' END AS above FROM k
)
SELECT doc_id, trim(regexp_replace(regexp_replace(body, '(\r?\n)+', ' ', 'g'), '[ \t]+', ' ', 'g')) AS content,
  CASE WHEN label <> '' THEN '(' || {HEADING.replace("(line,", "(label,")} || ')' END AS label,
  CASE WHEN regexp_matches(text, {_re2(P.SUFFIX_NOTE)}) THEN lower(regexp_extract(text, {_re2(P.SUFFIX_NOTE)}, 1)) || '.' || regexp_extract(text, {_re2(P.SUFFIX_NOTE)}, 2)
       WHEN regexp_matches(text, {_re2(P.SUFFIX_MARK)}) THEN lower(regexp_extract(text, {_re2(P.SUFFIX_MARK)}, 1))
       WHEN regexp_matches(text, {_WORD_AFTER}) THEN lower(regexp_extract(text, {_WORD_AFTER}, 1))
       WHEN regexp_matches(text, {_re2(P.SUFFIX_NUMBER)}) AND number BETWEEN 1 AND 30
         THEN number || CASE WHEN g2 <> '' THEN ' ' || lower(g2) ELSE '' END || CASE WHEN above <> '' THEN '.' || above ELSE '' END END AS suffix
FROM m""")
def strip_footnotes(spark: SparkSession, d: str) -> DataFrame:
    """F11, F12, F18, F20 of every whole text."""
    docs = texts(spark, d).where("text is not null")
    return docs.select("doc_id", X.flatten(X.strip_footnotes("text")).alias("content"), X.annotation_label("text").alias("label"), X.sub_article_suffix("text").alias("suffix"))


# vectors and backfill -----------------------------------------------------------------------


@query("SELECT d.doc_id, d.n_chars FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def embed_missing(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a label stand for articles without a vector."""
    return incremental.missing(table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels"), ("doc_id",))


@query("""
WITH w AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS b FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents) WHERE w <> ''),
c AS (SELECT doc_id, b, count(*)::DOUBLE AS n FROM w GROUP BY 1, 2)
SELECT doc_id, b AS place, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 4) AS value FROM c""")
def embed_stub(spark: SparkSession, d: str) -> DataFrame:
    """V4: the stand-in's vectors through the provider path, their places above 0."""
    made = providers.embed_column(texts(spark, d), providers.HashingEmbedder(), "text")
    out = made.select("doc_id", F.posexplode("embedding").alias("place", "value")).where("value > 0")
    exact = F.round(F.col("value").cast("double"), 4)
    return out.select("doc_id", F.col("place").cast("long").alias("place"), exact.alias("value"))


# questions -----------------------------------------------------------------------------------

USER = "SELECT conv_id, turn, trim(text) AS q FROM conversations WHERE role = 'user' AND trim(text) <> ''"
FIRSTS = f"SELECT conv_id, min_by(q, turn) AS q, min(turn) AS turn FROM ({USER}) GROUP BY conv_id, lower(upper(q))"
SETS = f"SELECT conv_id, q, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM ({FIRSTS})"


def question_sets(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "conversations").where("role = 'user'")
    return questions.merge_unique(asked, "conv_id", "text", "turn", 10)


@query(f"SELECT conv_id, n::BIGINT AS n, q AS question FROM ({SETS}) WHERE n <= 10")
def dedup_questions(spark: SparkSession, d: str) -> DataFrame:
    """A conversation as an article, what its user says as questions."""
    return question_sets(spark, d).select("conv_id", F.posexplode("questions").alias("p", "question")).select("conv_id", (F.col("p") + 1).cast("long").alias("n"), "question")


@query("SELECT conv_id, " + ", ".join(f"coalesce(max(CASE WHEN n = {k} THEN q END), '') AS question_{k}" for k in range(1, 6)) + f" FROM ({SETS}) GROUP BY 1")
def questions_wide(spark: SparkSession, d: str) -> DataFrame:
    """A9, K4."""
    return questions.wide(question_sets(spark, d), 5)


@query(f"SELECT conv_id, count(*) AS n FROM ({SETS}) GROUP BY 1 HAVING count(*) >= 2 ORDER BY conv_id LIMIT 20")
def budget_take(spark: SparkSession, d: str) -> DataFrame:
    """T5: the first 20 conversations (200 questions, 10 each) with two questions or more."""
    sets = question_sets(spark, d).select("conv_id", F.size("questions").cast("long").alias("n")).withColumn("ok", F.col("n") >= 2)
    return questions.take_budget(sets, 200 // 10, "conv_id").drop("ok")


@query("""
SELECT toxic, count(*) AS checked_count, sum(quality)::BIGINT AS relevant_count,
       CASE WHEN avg(quality) >= 0.75 THEN 'high' WHEN avg(quality) <= 0.34 THEN 'low' ELSE 'medium' END AS overall FROM labels GROUP BY 1""")
def relevance_summary(spark: SparkSession, d: str) -> DataFrame:
    """Quality as relevance, by toxicity."""
    return search.relevance(table(spark, d, "labels").withColumn("is_relevant", F.col("quality") == 1), ["toxic"])


@query(f"""
WITH h AS (SELECT vec_id, s, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM ({HITS}) WHERE s >= 0.0 ORDER BY rank LIMIT 50)
SELECT rank, vec_id, CASE WHEN rank <= 30 THEN coalesce(quality = 1, false) END AS ai_is_relevant, CASE WHEN rank <= 30 THEN coalesce(least(greatest(quality - toxic / 2.0, 0), 1), 0)::DOUBLE END AS ai_relevance_score
FROM h LEFT JOIN labels ON doc_id = vec_id""")
def judged_hits(spark: SparkSession, d: str) -> DataFrame:
    """The 50 best of all vectors for vector 0, the first 30 with what the labels of that number say of them."""
    best = search.ranked(search.search(table(spark, d, "embeddings"), vector0(spark, d), 50, 0.0, ["vec_id"]), ["vec_id"])
    said = best.join(table(spark, d, "labels"), F.col("doc_id") == F.col("vec_id")).select((F.col("rank") - 1).alias("index"), (F.col("quality") == 1).alias("is_relevant"), (F.col("quality") - F.col("toxic") / 2).alias("score"), F.lit("label").alias("reason"), F.lit(0).alias("pos"))
    return search.judged(best, said, 30).select(F.col("rank").cast("long").alias("rank"), "vec_id", "ai_is_relevant", "ai_relevance_score")


@query(r"""
WITH k AS (SELECT event_id, props, unnest(json_keys(props)) AS name FROM events),
v AS (SELECT event_id, name, json_extract(props, '$.' || name)::VARCHAR AS value FROM k
      UNION ALL SELECT event_id, 'note', '"a\\lb"' FROM events WHERE props IS NOT NULL AND event_id % 3 = 2)
SELECT event_id, '{' || string_agg('"' || name || '": ' || value, ', ' ORDER BY name) || '}' AS parsed FROM v GROUP BY 1""")
def json_repair(spark: SparkSession, d: str) -> DataFrame:
    """events' properties in a fence, in prose, and with a bad escape."""
    e = table(spark, d, "events").select("event_id", "props")
    bad = F.concat(F.lit('{"note": "a\\lb", '), F.expr("substring(props, 2)"))
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here: "), F.col("props"), F.lit("!"))).otherwise(bad)
    return e.select("event_id", providers.parsed_column(said).alias("parsed"))


@query(r"SELECT event_id, CASE WHEN regexp_matches(props, '(?s)\{.*\}') THEN regexp_extract(props, '(?s)(\{.*\})', 1) END AS object FROM (SELECT event_id, 'said: ' || props || ' .' AS props FROM events)")
def outer_json(spark: SparkSession, d: str) -> DataFrame:
    """F30."""
    return table(spark, d, "events").select("event_id", X.outer_json(F.concat(F.lit("said: "), F.col("props"), F.lit(" ."))).alias("object"))


@query("""
WITH a AS (
  SELECT item_id, 'Read this legal article and write 10 short study questions about it in French, without answers.' || chr(10)
    || 'Reply with one JSON object: the key questions holds a list of 10 strings.' || chr(10) || chr(10) || '{"id": ' || item_id
    || ', "article_number": null, "document_name": null, "livre": "", "titre": "", "chapitre": "", "section": "", "sous_section": "", "pages": "", "content": '
    || to_json(coalesce(text, '')) || '}' AS prompt FROM benchmark
)
SELECT item_id AS article_id, n::BIGINT AS n, 'Que prévoit le point ' || n || ' (' || substr(md5(prompt), 1, 6) || ') ?' AS question, CAST(NULL AS VARCHAR) AS error
FROM a, range(1, 11) r(n)""")
def generated_questions(spark: SparkSession, d: str) -> DataFrame:
    """G1-G3, F34, F35 with the stand-in model, for every benchmark item as an article; a row per question."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content"))
    made = providers.question_column(items, providers.TemplateChat())
    return made.select("article_id", "error", F.posexplode_outer("questions").alias("p", "question")).select("article_id", (F.col("p") + 1).cast("long").alias("n"), "question", "error")


@query(f"""
SELECT vec_id, '#' || vec_id || ' - Similarity: ' || printf('%.4f', s) || ' (' || printf('%.2f', s * 100) || '%)' || chr(10) || 'Article: ' || label || chr(10) || 'Page(s): ?' || chr(10) AS shown FROM ({HITS}) WHERE s >= 0.2""")
def result_text(spark: SparkSession, d: str) -> DataFrame:
    """F36."""
    h = search.above(hits(spark, d), 0.2)
    none = F.lit(None).cast("string")
    return h.select("vec_id", X.result_text("vec_id", "similarity", F.col("label").cast("string"), none, none, none).alias("shown"))
