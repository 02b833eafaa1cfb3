"""Shuffling many small numeric entries as packed blobs.

An operator that exchanges one entry per window or block of a text would pay tens
of bytes and a JVM row for each.  Here a Python task sorts the entries of an
Arrow batch by target partition and sends one row per target, with a binary
column of raw little-endian numbers per field.  Spark still does the shuffle,
with its fault tolerance and spill; only the rows are fewer and larger.

A target partition is the top of an entry's 64-bit key, so equal keys meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

NULL_ID = np.iinfo(np.int64).min  # a null id, before all others


TARGET_BYTES = 16 << 20  # of the input (as its files hold it), per task of an exchange
MOST_TARGETS = 200_000


def targets(spark: SparkSession, df: DataFrame | None = None) -> int:
    """The session's shuffle partitions; more where the planner knows the input to be larger than so many tasks should hold."""
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if df is not None:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size < 1 << 60:  # else unknown
            n = max(n, min(size // TARGET_BYTES, MOST_TARGETS))
    return n


def target_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def schema(fields: dict[str, str]) -> str:
    """Spark schema of the blobs of such fields (name -> numpy type)."""
    return "target int, kind int, " + ", ".join(f"{f} binary" for f in fields)


def blobs(kind: int, key: np.ndarray, fields: dict[str, np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
    """One row per target that gets any of the entries; the order of entries is kept within a target."""
    if not len(key):
        return
    target = target_of(key, n)
    order = np.argsort(target, kind="stable")
    target = target[order]
    ends = np.flatnonzero(np.diff(target, append=n)) + 1
    starts = np.concatenate([[0], ends[:-1]])
    columns = []
    for values in fields.values():
        raw = np.ascontiguousarray(values[order])
        width = raw.dtype.itemsize * (raw.shape[1] if raw.ndim == 2 else 1)
        offsets = np.concatenate([[0], ends * width]).astype(np.int32)
        columns.append(pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())]))
    yield pa.RecordBatch.from_arrays([pa.array(target[starts], pa.int32()), pa.array(np.full(len(ends), kind, np.int32)), *columns], ["target", "kind", *fields])


def exchanged(packed: DataFrame, n: int) -> DataFrame:
    return packed.repartitionById(n, "target")


def gathered(batches: Iterable[pa.RecordBatch], fields: dict[str, str], keep: Callable[[int], bool] = lambda kind: True) -> dict[int, dict[str, np.ndarray]]:
    """All entries of a task, by kind and field."""
    parts: dict[int, dict[str, list]] = {}
    for batch in batches:
        kinds = batch.column("kind").to_pylist()
        for f in fields:
            for kind, value in zip(kinds, batch.column(f)):
                if keep(kind):
                    parts.setdefault(kind, {}).setdefault(f, []).append(value.as_py())
    return {k: {f: np.frombuffer(b"".join(x), fields[f]) for f, x in own.items()} for k, own in parts.items()}


def ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)


def id_array(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == NULL_ID)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Start of each run of equal rows in sorted columns."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)
