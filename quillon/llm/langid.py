"""Language identification with hyperdimensional profiles (operator 8).

Each letter of any script (a code point, case folded) has a random +-1 vector, made
from its hash.  A letter n-gram's vector binds (multiplies)
its letters' vectors, each permuted (rotated) by its place; a document bundles
(adds) its n-grams' vectors, damped by log(1 + count); a language's prototype
bundles the unit vectors of its training documents.  The prediction is the
language of greatest cosine, the score that cosine (0 at least).

The distinct n-grams of a batch are bound once, some at a time, and bundled for all
its documents: those that many documents hold by one matrix product, others row by row.  Prototypes are summed as integers by Spark, so they don't
depend on the order of tasks; languages x dimensions numbers reach the driver.

Training uses up to about ``PER_LANGUAGE`` rows of each language, chosen by the
hash of the id.  Cases: null text or one without a letter is ``und`` with score 0;
null languages aren't learned; with nothing to learn from, all is ``und``; ties
go to the language that sorts first; result columns replace others of their name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import words as W

DIMENSIONS = 1024
PER_LANGUAGE = 4_000
DENSE = 16  # an n-gram that one document in so many holds goes into the product
BLOCK = 4096
UNKNOWN = "und"
_SCALE = 1 << 40
_LOW = (1 << 21) - 1

_table: np.ndarray | None = None


def symbol_table() -> np.ndarray:
    """Code point -> symbol: 0 for what is no letter, else the code point with its case folded."""
    global _table
    if _table is None:
        table = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                table[c] = ord(s.lower()[0])
        _table = table
    return _table


def letter_vectors(symbols: np.ndarray) -> np.ndarray:
    """+-1 vectors of symbols, each from its hash alone."""
    words = np.arange(DIMENSIONS // 64, dtype=np.uint64)
    bits = W.mix(W.mix(symbols.astype(np.uint64) + W.STEPS[1])[:, None] + W.STEPS[2] * (words + W.U(1)))
    return np.unpackbits(bits.astype("<u8").view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def bound(grams: np.ndarray) -> np.ndarray:
    """Vectors of 3-grams of symbols, 21 bits each: the letters' vectors, permuted for their place, multiplied."""
    letters, place = np.unique(np.stack([grams >> 42, grams >> 21 & _LOW, grams & _LOW]), return_inverse=True)
    base = letter_vectors(letters)
    first, second, third = place.reshape(3, -1)
    return np.roll(base, 2, 1)[first] * np.roll(base, 1, 1)[second] * base[third]


def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors of the documents, whether each has a letter)."""
    table = symbol_table()
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for first, data, borders in W.chunks(texts, W.CHUNK_BYTES // 2):
        n = len(borders) - 1
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = lead[borders]
        # documents side by side, each with a blank before it, and one at the end
        symbols = np.zeros(len(codes) + n + 1, np.int32)
        doc = np.repeat(np.arange(n), np.diff(at))
        symbols[np.arange(len(codes)) + doc + 1] = table[codes]
        owner = np.zeros(len(symbols), np.int64)
        owner[at[:-1] + np.arange(n)] = 1
        owner = np.cumsum(owner) - 1
        stay = np.ones(len(symbols), bool)
        stay[1:] = (symbols[1:] > 0) | (symbols[:-1] > 0)
        stay[at[:-1] + np.arange(n)] = True
        symbols, owner = symbols[stay].astype(np.int64), owner[stay]
        if len(symbols) < 3:
            continue
        gram = symbols[:-2] << 42 | symbols[1:-1] << 21 | symbols[2:]
        same = (owner[:-2] == owner[1:-1]) & (symbols[1:-1] > 0)  # around a letter; the blank after a document is the next one's
        grams, column = np.unique(gram[same], return_inverse=True)
        if not len(grams):
            continue
        keys, times = np.unique(column * n + owner[:-2][same], return_counts=True)
        column, row, weight = keys // n, keys % n, np.log1p(times).astype(np.float32)
        often = np.bincount(column, minlength=len(grams)) * DENSE >= n
        part, at = out[first : first + n], np.zeros(len(grams), np.int64)
        for dense in (True, False):
            chosen = np.flatnonzero(often == dense)
            for k in range(0, len(chosen), BLOCK):
                some = chosen[k : k + BLOCK]
                made = bound(grams[some])
                at[some] = np.arange(len(some))
                lo, hi = np.searchsorted(column, [some[0], some[-1] + 1])
                own = lo + np.flatnonzero(often[column[lo:hi]] == dense)
                if dense:
                    counts = np.zeros((n, len(some)), np.float32)
                    counts[row[own], at[column[own]]] = weight[own]
                    part += counts @ made
                    continue
                own = own[np.argsort(row[own], kind="stable")]
                for j in range(0, len(own), BLOCK):
                    few = own[j : j + BLOCK]
                    starts = X.runs(row[few])
                    part[row[few][starts]] += np.add.reduceat(made[at[column[few]]] * weight[few, None], starts, axis=0)
    size = np.sqrt((out.astype(np.float64) ** 2).sum(1))
    known = size > 0
    out[known] /= size[known, None].astype(np.float32)
    return out, known


def held_out(id: Column) -> Column:
    """Whether crc32 of the id as text is 0 modulo 5; false for a null id."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(df: DataFrame, id: str = "doc_id", text: str = "text", language: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages, unit prototypes) of the rows."""
    rows = df.select(F.col(id).alias("_id"), F.col(text).alias("_text"), F.col(language).alias("_lang")).where("_lang is not null and _text is not null and _id is not null")
    sizes = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not sizes:
        return [], np.zeros((0, DIMENSIONS))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])[F.col("_lang")]
    rows = rows.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < share * (1 << 20)).select("_lang", "_text")

    def bundle(batches):
        for batch in batches:
            made, known = vectors(batch.column("_text"))
            langs = np.array(batch.column("_lang").to_pylist(), object)
            for lang in sorted(set(langs.tolist())):
                total = np.rint(made[known & (langs == lang)].astype(np.float64) * (_SCALE / 2**20)).sum(0).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(total)], ["lang", "place", "total"])

    sums = rows.mapInArrow(bundle, "lang string, place int, total long").groupBy("lang", "place").agg(F.sum("total").alias("total")).collect()
    langs = sorted({r["lang"] for r in sums})
    made = np.zeros((len(langs), DIMENSIONS))
    for r in sums:
        made[langs.index(r["lang"]), r["place"]] = r["total"]
    size = np.sqrt((made**2).sum(1))
    langs = [x for x, s in zip(langs, size) if s]
    return langs, made[size > 0] / size[size > 0, None]


def predict(df: DataFrame, prototypes: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """Adds lang_pred and score."""
    langs, made = prototypes
    names = np.array([*langs, UNKNOWN], object)
    made = made.T.astype(np.float32)

    @F.arrow_udf("lang_pred string, score double")
    def predicted(batch: pa.Array) -> pa.Array:
        own, known = vectors(batch)
        if langs:
            cosine = own @ made
            best = np.where(known, cosine.argmax(1), len(langs))
            score = np.where(known, np.clip(cosine.max(1), 0, 1), 0).astype(float)
        else:
            best, score = np.zeros(len(batch), int), np.zeros(len(batch))
        return pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return df.withColumn("_l", predicted(text)).withColumn("lang_pred", F.col("_l.lang_pred")).withColumn("score", F.col("_l.score")).drop("_l")
