"""Best-fit packing of token pieces into sequences (operator 3).

Only lengths decide a packing and there are at most ``capacity`` of them, so the
plan is made on the histogram: a document above one third of the capacity
shares its bin with at most one other of that kind, matched greedily (the
longest takes the longest that fits), then the smaller ones go, longest first,
each to the smallest gap that holds them.  All bins of one shape are handled as
one entry with a multiplicity, so the plan's size is bounded by the capacity
and not by the data; it is the only thing that reaches the driver.

The k-th piece of a length (a salted row number, no window spans a whole length)
looks its sequence and offset up in the plan.

Cases: null or empty text is the end token alone (one piece of length 1); an
empty table gives no rows; repeated rows are packed as often as they occur; null
ids are kept.  Columns other than the id are not carried, so names can't clash.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import opened_fast
from .tables import releasing, small_batches, written

ROWS_PER_SALT = 1_000_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens: full ones, but for the first."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if wanted, the packed ids."""
    small_batches(df.sparkSession)
    end = end_id.to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches):
        bpe = opened_fast(path)
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            rows: list[list] = [[] for _ in names]
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = bpe.encode(t) + end
                for k, (start, length) in enumerate(cut(len(ids) >> 2, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(rows, (doc, k, start, length, crc32(own), own)):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names)
        bpe.forget()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return df.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(releasing(run), schema)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths in a bin, number of such bins); every length is used as often as counted."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("lengths must be from 1 to the capacity")
    gaps: dict[int, list[list]] = {}
    order: list[int] = []

    def put(gap: int, items: list[int], times: int) -> None:
        if times:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append([items, times])

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            k = bisect_left(large, capacity - a + 1) - 1
            while k >= 0 and not left[large[k]] or k >= 0 and large[k] == a and left[a] < 2:
                k -= 1
            if k < 0 or large[k] > a:
                put(capacity - a, [a], left[a])
                left[a] = 0
                break
            b = large[k]
            times = left[a] // 2 if a == b else min(left[a], left[b])
            left[a] -= times
            left[b] -= times
            put(capacity - a - b, [a, b], times)
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[s]
        while todo:
            at = bisect_left(order, s)
            if at == len(order):
                fit = capacity // s
                put(capacity - fit * s, [s] * fit, todo // fit)
                todo %= fit
                put(capacity - todo * s, [s] * todo, 1 if todo else 0)
                break
            gap = order[at]
            items, times = gaps[gap][-1]
            fit = gap // s
            full = min(times, todo // fit)
            if full:
                put(gap - fit * s, items + [s] * fit, full)
                todo -= full * fit
                used = full
            else:
                put(gap - todo * s, items + [s] * todo, 1)
                todo, used = 0, 1
            gaps[gap][-1][1] -= used
            if not gaps[gap][-1][1]:
                gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(bisect_left(order, gap))
    return [(items, times) for group in gaps.values() for items, times in group]


def slots(bins: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lookup table: (length << 40 | first rank), first sequence, offset, sorted by the first."""
    seen: dict[int, int] = {}
    keys, sequences, offsets = [], [], []
    sequence = 0
    for items, times in bins:
        offset = 0
        for n in items:
            rank = seen.get(n, 0)
            keys.append(n << 40 | rank)
            sequences.append(sequence)
            offsets.append(offset)
            seen[n] = rank + times
            offset += n
        sequence += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return tuple(np.array(x, np.int64)[order] for x in (keys, sequences, offsets))


def place(rows: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to a table (doc_id, piece, length, ...) that can be read more than once."""
    salts = 1 + rows.count() // ROWS_PER_SALT
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    keys, sequences, offsets = slots(plan(histogram, capacity))

    @F.arrow_udf("sequence_id long, offset long")
    def look_up(length: pa.Array, rank: pa.Array) -> pa.Array:
        r = rank.to_numpy(zero_copy_only=False).astype(np.int64)
        wanted = length.to_numpy(zero_copy_only=False).astype(np.int64) << 40 | r
        at = np.searchsorted(keys, wanted, side="right") - 1
        if not len(at):
            return pa.StructArray.from_arrays([pa.array([], pa.int64())] * 2, ["sequence_id", "offset"])
        return pa.StructArray.from_arrays([pa.array(sequences[at] + r - (keys[at] & (1 << 40) - 1)), pa.array(offsets[at])], ["sequence_id", "offset"])

    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).select("length", "_salt", "_before")
    in_salt = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("_r", in_salt - 1).join(before, ["length", "_salt"])
    found = ranked.withColumn("_at", look_up("length", F.col("_r") + F.col("_before")))
    return found.select(*rows.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def pack(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places.  The pieces are written once to the shared folder: lengths, not texts, are what is moved."""
    return place(written(pieces(df, path, capacity, end_id, keep_ids=keep_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed ids of each sequence, from ``pack(..., keep_ids=True)``; a group is one sequence at most."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.unhex(F.array_join(parts, "")).alias("ids"))
