"""Question sets: merging (A8), wide rows (A9), budget (T5, A10), batches."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..providers import Chat, question_column


def merge_unique(df: DataFrame, key: str, question: str, order: str | list[str], limit: int) -> DataFrame:
    """(key, questions): the first spelling of each question regardless of case, in order, at most ``limit``."""
    order = [order] if isinstance(order, str) else order
    rows = df.select(key, X.strip(question).alias("_q"), F.struct(*order).alias("_o")).where("_q is not null and _q <> ''")
    first = rows.groupBy(key, X.casefolded("_q").alias("_k")).agg(F.min(F.struct("_o", "_q")).alias("_f"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("_f._o"))
    kept = first.withColumn("_n", n).where(F.col("_n") <= limit)
    numbered = F.array_sort(F.collect_list(F.struct("_n", F.col("_f._q").alias("q"))))
    return kept.groupBy(key).agg(F.transform(numbered, lambda s: s["q"]).alias("questions"))


def wide(sets: DataFrame, n: int, questions: str = "questions") -> DataFrame:
    """question_1 to question_n, blank where missing; more are cut."""
    others = [c for c in sets.columns if c != questions]
    return sets.select(*others, *(F.coalesce(F.try_element_at(questions, F.lit(k)), F.lit("")).alias(f"question_{k}") for k in range(1, n + 1)))


def target(records: int, per_article: int, least_total: int, most_total: int) -> int:
    """T5: how many articles to take; ValueError where the budget can't be met."""
    if per_article < 1 or most_total // per_article < 1:
        raise ValueError("the question budget is too low for the questions per article")
    if records < ceil(least_total / per_article):
        raise ValueError(f"{records} articles can't give {least_total} questions")
    return min(records, most_total // per_article)


def take_budget(done: DataFrame, n: int, order: str, ok: str = "ok") -> DataFrame:
    """T5: the first n successful articles, in order."""
    return done.where(ok).orderBy(order).limit(n)


def summary(sets: DataFrame, source: str, model: str, per_article: int, chunk: int, least_total: int) -> DataFrame:
    """One row with status, reason and all articles (a budget's worth)."""
    need = ceil(least_total / per_article)
    entry = F.struct("article_id", "questions")
    out = sets.agg(F.array_sort(F.collect_list(entry)).alias("articles"), F.count("*").alias("total_articles"))
    enough = F.col("total_articles") >= need
    return out.select(
        F.lit(source).alias("source_file"), F.lit(model).alias("model"), F.lit(per_article).alias("questions_per_article"), F.lit(chunk).alias("chunk_size"), "total_articles",
        F.when(enough, "completed").otherwise("stopped").alias("status"), F.when(enough, "").otherwise(f"fewer than {need} articles have questions").alias("stopped_reason"), "articles",
    )


def run(spark: SparkSession, articles: DataFrame, store: str, chat: Chat, n: int = 10, chunk: int = 5, most: int | None = None, order: str = "pos", id: str = "id", attempts: int = 3) -> dict:
    """Questions for articles in ordered batches of ``chunk``, until ``most`` have some, none are left, or a stop.

    Each batch's answers are written once to ``store/answers`` (batch_index, article_id,
    questions, error), so nothing is asked twice and what is done outlives the run; a
    later run takes up the articles that the store lacks.  Returns the status, the
    reason and how many articles have questions.  ``chunk`` articles go to the workers
    at a time, so it sets how many calls run side by side.
    """
    answers, done = f"{store}/answers", None
    schema = T.StructType([T.StructField("batch_index", T.IntegerType()), T.StructField("article_id", articles.schema[id].dataType), *T._parse_datatype_string("questions array<string>, error string, stop string")])
    empty = spark.createDataFrame([], schema)
    empty.write.mode("append").parquet(answers)
    done = spark.read.schema(schema).parquet(answers)
    index = (done.agg(F.max("batch_index")).first()[0] or 0) + 1
    got = done.where("questions is not null").count()
    status, reason, after = "completed", "", None
    todo = articles.join(done.where("questions is not null").select(F.col("article_id").alias(id)), id, "left_anti")
    while most is None or got < most:
        rows = (todo if after is None else todo.where(F.col(order) > F.lit(after))).orderBy(order).limit(chunk if most is None else min(chunk, most - got))
        batch = [r[order] for r in rows.select(order).collect()]  # at most ``chunk`` places
        if not batch:
            break
        after = batch[-1]
        made = question_column(rows.repartition(max(1, len(batch))), chat, n, attempts, id)
        made.select(F.lit(index).alias("batch_index"), "article_id", "questions", "error", "stop").write.mode("append").parquet(answers)
        mine = spark.read.schema(schema).parquet(answers).where(F.col("batch_index") == index)
        told = mine.agg(F.count_if(F.col("questions").isNotNull()).alias("n"), F.max("stop").alias("stop")).first()
        got += told["n"]
        if told["stop"] is not None:
            status, reason = "stopped", told["stop"]
            break
        index += 1
    return {"status": status, "stopped_reason": reason, "total_articles": got}


def batch_files(answers: DataFrame, path: str) -> None:
    """K6: a folder with a three-digit name per batch that has an answer; the batch in which a run stopped has none."""
    whole = answers.groupBy("batch_index").agg(F.max("stop").alias("s")).where("s is null").select("batch_index")
    rows = answers.where("questions is not null").join(whole, "batch_index", "left_semi")
    rows.select(F.format_string("%03d", "batch_index").alias("batch"), "article_id", "questions").write.mode("overwrite").partitionBy("batch").json(path)
