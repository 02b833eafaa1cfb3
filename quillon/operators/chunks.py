"""Semantic chunks: sentences (F24, F25) packed by length and likeness (V7, V8), as records (V9)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V


@dataclass(frozen=True)
class Packing:
    """Parameters, clamped."""

    target_chars: int = 900
    max_chars: int = 1400
    similarity: float = 0.72
    embed_batch: int = 16
    retries: int = 5

    def clamped(self) -> Packing:
        return Packing(max(200, self.target_chars), max(300, self.max_chars), min(1.0, max(0.0, self.similarity)), max(1, self.embed_batch), max(0, self.retries))


def _bounds(lengths: list[int], vectors: Iterable[list[float]] | None, p: Packing) -> list[int]:
    """How many sentences each chunk takes: the running chunk takes the next one unless that makes it too long, or it is long enough and unlike.

    Vectors are taken one by one, and of those taken only the running mean is kept.
    """
    out: list[int] = []
    now, taken, mean = 0, 0, None
    for n, v in zip(lengths, vectors if vectors is not None else repeat(None)):
        if taken:
            apart = now + 1 + n > p.max_chars
            if not apart and v is not None and now >= p.target_chars:
                apart = V.likeness(mean, v) < p.similarity
            if apart:
                out.append(taken)
                taken = 0
        if taken:
            now, taken = now + 1 + n, taken + 1
            mean = [(x + y) / 2 for x, y in zip(mean, v)] if v is not None else None
        else:
            now, taken, mean = n, 1, v
    return [*out, taken] if taken else out


def _fold(parts: str, stream: Callable[[list[str]], Iterator[list[float]]] | None, p: Packing) -> Column:
    """Chunks of an ordered array of sentences.  Their lengths go to Python, or for vectors the sentences themselves, and only the chunks' sizes come back.

    Vectors take some twenty times the room of their sentences, so none leave the worker:
    they are made as the fold asks for them, a document at a time.
    """
    lengths = F.transform(parts, F.length)
    kind = "array<struct<first:int,n:int>>"

    def placed(sizes: list[int]) -> list[dict]:
        out, at = [], 1
        for n in sizes:
            out.append({"first": at, "n": n})
            at += n
        return out

    made = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))

    @F.arrow_udf(kind)
    def by_length(sizes: pa.Array) -> pa.Array:
        return pa.array([placed(_bounds(own or [], None, p)) for own in sizes.to_pylist()], made)

    @F.arrow_udf(kind)
    def by_meaning(sentences: pa.Array) -> pa.Array:
        out = []
        for document in sentences:
            own = document.values.to_pylist() if document.is_valid else []
            out.append(placed(_bounds([*map(len, own)], stream(own), p)))
        return pa.array(out, made)

    bounds = by_length(lengths) if stream is None else by_meaning(F.col(parts))
    return F.transform(bounds, lambda b: F.array_join(F.slice(F.col(parts), b["first"], b["n"]), " "))


def pack_by_length(df: DataFrame, text: str = "content", p: Packing = Packing(), name: str = "chunks") -> DataFrame:
    """V8 with a threshold of 0: length alone decides."""
    p = p.clamped()
    staged = df.withColumn("_s", X.sentences(X.strip(F.coalesce(F.col(text), F.lit(""))), p.max_chars))
    return staged.withColumn(name, _fold("_s", None, p)).drop("_s")


def pack_by_meaning(df: DataFrame, embed, text: str = "content", p: Packing = Packing(), name: str = "chunks") -> DataFrame:
    """V8: ``embed`` is ``providers.embed_arrays`` of a provider; its vectors are made as they are packed."""
    p = p.clamped()
    staged = df.withColumn("_s", X.sentences(X.strip(F.coalesce(F.col(text), F.lit(""))), p.max_chars))
    return staged.withColumn(name, _fold("_s", embed.stream, p)).drop("_s")


def records(df: DataFrame, chunks: str = "chunks") -> DataFrame:
    """V9: a row per chunk with chunk_id, chunk_index and chunk_count; the article number or else its older name or "unknown" heads the id."""
    heads = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("article_number", "article") if c in df.columns]
    # an inner explode has the planner work out the whole array once more, early, to see that it isn't empty
    out = df.withColumn("chunk_count", F.size(chunks)).select("*", F.posexplode_outer(chunks).alias("_i", "_chunk")).where("_chunk is not null")
    out = out.withColumn("chunk_index", F.col("_i") + 1).withColumn("chunk_id", F.format_string("%s_%03d", F.coalesce(*heads, F.lit("unknown")), "chunk_index"))
    return out.withColumn("content", F.col("_chunk")).drop("_i", "_chunk", chunks)
