"""Embedding only what is missing (P7, J7, A6) and resuming.

The store is an append-only table keyed by (source_file, pos); a run embeds the
keys it lacks and appends them, so a stopped run resumes where it was without
rewriting anything.  ``follow`` does the same from a stream of new files.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..functions import vectors as V
from ..providers import Embedder, embed_column

KEYS = ("source_file", "pos")


def missing(articles: DataFrame, done: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows whose key has no vector yet."""
    return articles.join(done.select(*keys).distinct(), list(keys), "left_anti")


def counts(articles: DataFrame, embedding: str = "embedding") -> DataFrame:
    """(already, missing)."""
    has = V.has_embedding(embedding)
    return articles.agg(F.count_if(has).alias("already"), F.count_if(~has).alias("missing"))


def settings(given: dict, saved: dict, defaults: dict) -> dict:
    """What is given, else saved, else the default; an explicit 0 is a value."""
    return {k: next(x for x in (given.get(k), saved.get(k), v) if x is not None or x is v) for k, v in defaults.items()}


def latest(checkpoints: DataFrame, path: str = "path") -> DataFrame:
    """The checkpoint with the largest six-digit number; others count as -1."""
    number = F.coalesce(F.regexp_extract(path, r"(\d{6})\.[a-z]+$", 1).try_cast("int"), F.lit(-1))
    return checkpoints.agg(F.max_by(path, number).alias("path"), F.max(number).alias("number"))


def _stored(spark: SparkSession, store: str) -> DataFrame | None:
    """The store, or None where there is none yet."""
    try:
        return spark.read.parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def backfill(spark: SparkSession, articles: DataFrame, store: str, provider: Embedder, text: str = "content", keys: tuple[str, ...] = KEYS) -> int:
    """Embeds what the store lacks and appends it; returns how many failed (they stay missing)."""
    done = _stored(spark, store)
    todo = (articles if done is None else missing(articles, done, keys)).where(X.has_text(text))  # P8
    made = embed_column(todo, provider, text)
    # what is asked for is asked once: the count comes out of the same pass as the rows
    seen = Observation()
    observed = made.observe(seen, F.count(F.lit(1)).alias("wanted"), F.count("embedding").alias("made"))
    observed.where("embedding is not null").drop("embed_error").write.mode("append").parquet(store)
    return seen.get["wanted"] - seen.get["made"]


def follow(articles: DataFrame, store: str, checkpoint: str, provider: Embedder, text: str = "content", keys: tuple[str, ...] = KEYS) -> StreamingQuery:
    """Embeds a stream of articles into the store as files arrive; one pass over what is there, then ends.

    A batch that is tried again after a failure, and articles that another run has
    embedded, find their keys in the store and aren't written twice.
    """

    def append(batch: DataFrame, _: int) -> None:
        backfill(batch.sparkSession, batch.dropDuplicates(list(keys)), store, provider, text, keys)

    return articles.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
