"""Page lines: assembly (S3), page limit (S2), body size (A2), recurring margins (A3, J3), margin removal (P1), heading levels.

A line table has doc, page, line_no, text, size, fonts, y0, y1, page_height; a row
is a line, and (doc, page, line_no) is its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

NO_SIZE = 12.0


def assemble(spans: DataFrame) -> DataFrame:
    """S3: lines from rows with ``spans`` (array of text, size, font); only text blocks where a block_type column is there; empty lines go."""
    rows = spans.where("block_type = 0") if "block_type" in spans.columns else spans
    said = F.filter("spans", lambda s: F.coalesce(s["text"], F.lit("")) != "")
    out = rows.withColumn("text", X.normalise_heading(F.array_join(F.transform("spans", lambda s: F.coalesce(s["text"], F.lit(""))), "")))
    out = out.withColumn("size", F.coalesce(F.array_max(F.transform(said, lambda s: s["size"])), F.lit(0.0))).withColumn("fonts", F.transform("spans", lambda s: s["font"]))
    return out.where("text <> ''").drop("spans", "block_type")


def first_pages(lines: DataFrame, n: int = 0) -> DataFrame:
    """The first n pages; 0 or less: all."""
    return lines.where(F.col("page") <= n) if n > 0 else lines


def body_sizes(lines: DataFrame) -> DataFrame:
    """A2: (doc, body_size), the exact median of all sizes above 0, 12 where there are none."""
    return lines.groupBy("doc").agg(F.coalesce(F.median(F.when(F.col("size") > 0, F.col("size"))), F.lit(NO_SIZE)).alias("body_size"))


def zone() -> Column:
    h = F.col("page_height")
    return F.when(h > 0, F.when(F.col("y0") <= h * 0.14, "top").when(F.col("y1") >= h * 0.88, "bottom"))


def recurring(lines: DataFrame) -> DataFrame:
    """A3: (doc, zone, signature, times) of margin lines that occur twice or more."""
    found = lines.where(zone().isNotNull()).select("doc", zone().alias("zone"), X.margin_signature("text").alias("signature"))
    # the length comes out of the aggregate, or the filter would move below it and work out each signature twice
    times = found.groupBy("doc", "zone", "signature").agg(F.count("*").alias("times"), F.max(F.length("signature")).alias("_n"))
    return times.where("times >= 2 and _n >= 6").drop("_n")


def drop_margins(lines: DataFrame) -> DataFrame:
    """Without running headers, footers and page numbers; adds body_size.

    One pass: A2 and A3 are windows over the lines hashed by document, and each text
    is normalised once.  The result is still hashed by document (``articles.extract``
    builds on that).
    """
    placed = lines.where("doc is not null").withColumn("text", X.normalise_heading("text")).withColumn("zone", zone())
    placed = placed.withColumn("signature", F.when(F.col("zone").isNotNull(), X.margin_signature("text", normal=True)))
    median = F.median(F.when(F.col("size") > 0, F.col("size"))).over(Window.partitionBy("doc"))
    times = F.count("*").over(Window.partitionBy("doc", "zone", "signature"))
    again = F.col("zone").isNotNull() & (F.length("signature") >= 6) & (times >= 2)
    marked = placed.select("*", F.coalesce(median, F.lit(NO_SIZE)).alias("body_size"), F.when(again, times).alias("times"))
    text, size, body = F.col("text"), F.coalesce("size", F.lit(0.0)), F.col("body_size")
    heading = F.coalesce(text.rlike(P.java(P.STRUCTURAL)), F.lit(False)) & ((size <= 0) | (size >= body))
    small = (size > 0) & (size <= body * 0.9) & text.rlike(P.java(P.MARGIN_WORDS))
    margin = F.col("zone").isNotNull() & ~heading & (F.col("times").isNotNull() | text.rlike(P.java(P.PAGE_NUMBER)) | small)
    return marked.where((text != "") & ~X.is_header_footer("text", normal=True) & ~F.coalesce(margin, F.lit(False))).drop("zone", "signature", "times")


def level(text: str = "text", size: str = "size", fonts: str = "fonts", body_size: str = "body_size", unlabeled: Column | None = None) -> Column:
    """P2 of a normalised line: livre, titre, chapitre, sous_section or section, in this order; null for ordinary lines.  ``unlabeled``: documents with sub-sections that bear no number."""
    t = F.col(text)
    number = F.regexp_extract(t, P.java(P.NUMBERED_SUB), 1).try_cast("int")
    title = F.regexp_extract(t, P.java(P.NUMBERED_SUB), 2)
    bold, s = X.is_bold(fonts), F.coalesce(F.col(size), F.lit(0.0))
    numbered = number.isNotNull() & number.between(1, 30) & X.is_numbered_sub_title(title, normal=True) & ~title.rlike(P.LEADERS) & (bold | (s >= F.col(body_size) * 1.06))
    bare = F.lit(False)
    if unlabeled is not None:
        bare = unlabeled & (bold | (s >= F.col(body_size) * 1.08)) & number.isNull() & X.is_unlabeled_sub_title(t, normal=True)
    sub = t.rlike(P.java(P.SUB_SECTION_START)) | numbered | bare
    return (
        F.when(t.rlike(P.java(P.LIVRE)), "livre")
        .when(t.rlike(P.java(P.TITRE)), "titre")
        .when(t.rlike(P.java(P.CHAPITRE)), "chapitre")
        .when(F.coalesce(sub, F.lit(False)), "sous_section")
        .when(t.rlike(P.java(P.SECTION)), "section")
    )


def unlabeled_allowed(doc: str = "doc") -> Column:
    """P3."""
    return F.lower(doc).contains("dahir")
