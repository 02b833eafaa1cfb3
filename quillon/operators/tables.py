"""Row numbers (W1), batches (W5), running offsets (W7), group numbers and chunk ids (A4, A5), pages of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

GROUP = tuple("document_name livre titre chapitre section sous_section article_number".split())


SLICES = 32
ONE_TASK = 64 << 20  # bytes that the planner knows to be all there is, so that any group fits a task


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """1-based row numbers in each group, replacing a column of that name; nulls come first and count as a value of the group.

    A group may hold a third of all rows.  It is therefore numbered in ``SLICES``
    slices of the first order column (a number or a time; quantiles over all rows are
    the cuts), each by a window of its own, and a slice's numbers start after the
    counts of those before it, a row per group and slice.  Other orders, and tables of
    ``ONE_TASK`` at most, take one window; the numbers are the same.
    """
    kept = [c for c in df.columns if c != name]
    lead = F.col(order[0])
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= ONE_TASK
    if small or not isinstance(df.schema[order[0]].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return df.select(*kept, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).alias(name))
    cuts = df.agg(F.percentile_approx(lead, [k / SLICES for k in range(1, SLICES)], 1000).alias("c")).first()["c"] or []
    slices = F.lit(-1)
    if cuts:
        at = sum(((lead > F.lit(c)).cast("int") for c in sorted(set(cuts))), F.lit(0))
        slices = F.coalesce(at, F.lit(-1))
    sliced = df.select(*kept, slices.alias("_slice"))
    counts = sliced.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(g).alias(f"_k{k}") for k, g in enumerate(group)), F.col("_slice").alias("_s"), before.alias("_before"))
    own = sliced.select("*", F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(*order)).alias("_r"))
    same = F.col("_slice") == F.col("_s")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_k{k}"))
    return own.join(counts, same).select(*kept, (F.col("_r") + F.col("_before")).alias(name))


def assign_ids(df: DataFrame, file: str, order: str | list[str], name: str = "id") -> DataFrame:
    """1-based ids in each file, replacing a column of that name."""
    return numbered(df, [file], [order] if isinstance(order, str) else order, name)


def batches(df: DataFrame, size: int, order: str, by: str, name: str = "batch_index") -> DataFrame:
    """1-based numbers of runs of ``size`` rows."""
    made = numbered(df, [by], [order], "_at")
    return made.withColumn(name, F.floor((F.col("_at") - 1) / max(1, size)).cast("int") + 1).drop("_at")


def offsets(lines: DataFrame, doc: str = "doc", order: str = "line_no", text: str = "text") -> DataFrame:
    """Where each line starts in the text of its document, lines joined by line feeds."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0)))


def number_chunks(chunks: DataFrame, file: str, order: str, group: tuple[str, ...] = GROUP) -> DataFrame:
    """A4, A5: group_id by first appearance in the file, chunk_index, chunk_count and chunk_id.

    Absent columns and absent keys are empty strings.  First places are computed
    per group and ranked among groups, so no window spans all rows of a file, and
    places in a group by ``numbered``.
    """
    own = [c for c in group if c in chunks.columns]
    keyed = chunks.withColumns({f"_g{k}": F.coalesce(F.col(c).cast("string"), F.lit("")) for k, c in enumerate(own)})
    keys = [file, *(f"_g{k}" for k in range(len(own)))]
    first = keyed.groupBy(*keys).agg(F.min(order).alias("_first"), F.count("*").alias("chunk_count"))
    first = first.withColumn("group_id", F.dense_rank().over(Window.partitionBy(file).orderBy("_first")))
    first = first.select(*(F.col(k).alias(f"_j{n}") for n, k in enumerate(keys)), "chunk_count", "group_id")
    same = F.col(file).eqNullSafe(F.col("_j0"))
    for n, k in enumerate(keys[1:], 1):
        same = same & (F.col(k) == F.col(f"_j{n}"))
    out = numbered(keyed.drop("chunk_count", "group_id"), keys, [order], "chunk_index").join(first, same).drop(*(f"_j{n}" for n in range(len(keys))))
    number = F.nullif(X.strip(F.coalesce(F.col("article_number").cast("string"), F.lit(""))), F.lit("")) if "article_number" in own else F.lit(None).cast("string")
    out = out.withColumn("chunk_id", F.format_string("%s_%03d_g%03d", F.coalesce(number, F.lit("unknown")), "chunk_index", "group_id"))
    return out.drop(*(f"_g{k}" for k in range(len(own))))


def clean_chunks(chunks: DataFrame, file: str, order: str, content: str = "content") -> DataFrame:
    """Cleaned contents, without empty and footer-only ones, numbered anew."""
    cleaned = chunks.drop("article_id").withColumn(content, X.clean_chunk(content))
    return number_chunks(cleaned.where((F.col(content) != "") & ~X.is_footer_only(content)), file, order)


def spans_of_pages(lines: DataFrame, doc: str, group: str, page: str = "page") -> DataFrame:
    """The pages that each group of lines touches."""
    return lines.groupBy(doc, group).agg(X.page_span(F.min(page), F.max(page)).alias("pages"))


def stop_status(n: Column, minimum: Column | int) -> Column:
    """A10."""
    return F.when(n >= minimum, "completed").otherwise("stopped")
