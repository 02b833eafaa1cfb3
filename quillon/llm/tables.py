"""Tables of a data folder and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.files import small_batches, spread


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents, on all cores even where one file has but a few row groups."""
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spread(df.select(*columns) if columns else df)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it names none, a local session gets a temporary folder that goes with the
    process; on a cluster, whose executors wouldn't share one, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def release() -> None:
    """Gives freed memory back at the end of a task; Python workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def releasing(run: Callable) -> Callable:
    """The function over batches, with ``release`` after the last."""

    @functools.wraps(run)
    def over(batches):
        yield from run(batches)
        release()

    return over


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, no lineage behind them, readable after any executor is lost."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def appended(df: DataFrame, make: Callable[[pa.Array], list[pa.Array]], column: str, fields: str, drop: tuple[str, ...] = (), rows: int = 256) -> DataFrame:
    """The columns but for ``drop``, and those that ``make`` computes from ``column``; columns of the new names are replaced.

    Batches go through in slices of a few rows, so that a task never holds the
    results of a whole Arrow batch.
    """
    new = T._parse_datatype_string(fields)
    names = [f.name for f in new]
    kept = [c for c in df.columns if c not in names and c not in drop]
    source = df.select(*(df[c] for c in kept), df[column].alias("_input"))

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *make(part.column(len(kept)))], [*kept, *names])

    small_batches(df.sparkSession)
    return source.mapInArrow(releasing(run), T.StructType([*(df.schema[c] for c in kept), *new]))
