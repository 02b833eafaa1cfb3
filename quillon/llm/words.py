"""Words, lines and their hashes over whole Arrow batches of texts, in numpy.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; texts are UTF-8 as
Arrow holds them, so nothing is decoded and no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 20

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.default_rng(20240517)
BYTE_HASH = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER_HASH = BYTE_HASH.copy()
LOWER_HASH[65:91] = BYTE_HASH[97:123]
STEPS = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * U(2) + U(1)
_factors: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def factors(n: int, lane: int = 0) -> np.ndarray:
    """Random odd factors of the first n places: no text can be built on them, as it can on the powers of a base modulo 2**64."""
    if len(own := _factors.get(lane, BYTE_HASH[:0])) < n:
        size = 1 << max(8, (n - 1).bit_length())
        own = _factors[lane] = mix((np.arange(1, size + 1, dtype=np.uint64) + (U(lane) << U(40))) * U(0x9E3779B97F4A7C15)) | U(1)
    return own[:n]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, bytes, document borders in them) for runs of documents of about `limit` bytes; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def segment_hash(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hash of each non-empty segment of the bytes; those of two lanes are independent."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    within = np.arange(total) - np.repeat(ends - lengths, lengths)
    values = table[data[np.repeat(starts, lengths) + within]]
    values *= factors(int(lengths.max()), lane)[within]
    return mix(np.add.reduceat(values, ends - lengths) + lengths.astype(np.uint64))


def words(data: np.ndarray, borders: np.ndarray, table: np.ndarray = BYTE_HASH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, hash) of every word of a chunk."""
    solid = ~BLANK[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = borders[:-1][borders[:-1] < len(data)]
    begins[inner] = solid[inner]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    last = borders[1:] - 1
    last = last[last >= 0]
    stops[last] = solid[last]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(stops) - starts + 1
    doc = np.searchsorted(borders, starts, side="right") - 1
    return doc, starts, lengths, segment_hash(data, starts, lengths, table)


def lines(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of every line of a chunk, empty ones too: as many as line feeds plus one a document."""
    feeds = np.flatnonzero(data == 10)
    doc_of_feed = np.searchsorted(borders, feeds, side="right") - 1
    starts = np.concatenate([borders[:-1], feeds + 1])
    ends = np.concatenate([borders[1:], feeds])
    doc = np.concatenate([np.arange(len(borders) - 1), doc_of_feed])
    starts = starts[order := np.lexsort((starts, doc))]
    # the k-th line of a document ends at its k-th feed, the last at the document's end
    doc_end = np.concatenate([np.arange(len(borders) - 1), doc_of_feed])
    ends = ends[np.lexsort((ends, doc_end))]
    return doc[order], starts, ends - starts


def grams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of n words within a document."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    made = np.zeros(len(at), np.uint64)
    for k in range(n):
        made += hashes[at + k] * STEPS[k]
    return at, mix(made)
