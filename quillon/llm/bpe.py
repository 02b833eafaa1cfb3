"""Byte-level BPE (operators 2 and 9): merging by a heap over a linked list.

A piece of text is merged by popping the lowest-ranked adjacent pair from a
heap while the symbols live in a doubly linked list held in two arrays; heap
entries whose neighbours have changed since they were pushed are stale and are
skipped.  Operator 2 reads the identifiers off the list, operator 9 only counts
merges (tokens = initial symbols - merges) and never makes identifiers.

Merging never crosses a piece border, so results are memoised by piece.  The
outer key is a blank-delimited word: a border between a non-blank and a single
space (or line feed) followed by a non-blank is always a piece border in the
byte-level pattern, so ``str.split`` finds it at C speed.  Any text with another
arrangement of white space goes through the tokenizer's own splitter.  The memo
is emptied when it reaches ``memo`` words; it changes speed, never results.

Cases: null text counts as empty (no tokens, decoded text ``''``); special
tokens inside a text are matched whole, as the library does by default; very
long words are merged in O(n log n) and are not memoised.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import appended

MEMO_WORDS = 250_000
LONGEST_MEMO = 48

#: The library's pattern with its classes spelled out for characters below U+0250; texts beyond use its own splitter.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[^\0-\u024f]")


class _Irregular(Exception):
    """White space that the fast splitter doesn't cover."""


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable stand-in, as byte-level vocabularies write them."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def merge(symbols: list[int], ranks: dict[int, int], made: list[int], wide: int) -> tuple[list[int], int]:
    """Merge adjacent symbols by rank: (linked list with None for what was merged away, number of merges).

    ``ranks[a << wide | b]`` is the rank of the pair and ``made[rank]`` the symbol
    that it makes.  ``pair[i]`` holds the present rank of the pair that starts at
    node i, so a popped entry with another rank is stale.
    """
    n = len(symbols)
    get = ranks.get
    pair = [get(a << wide | b, -1) for a, b in zip(symbols, symbols[1:])]
    at = n.bit_length()  # an entry is one integer, rank before node; short pieces stay in machine words
    low = (1 << at) - 1
    heap = [r << at | i for i, r in enumerate(pair) if r >= 0]
    if not heap:
        return symbols, 0
    heapify(heap)
    pair.append(-1)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    merges = 0
    while heap:
        entry = heappop(heap)
        i = entry & low
        r = entry >> at
        if pair[i] != r:
            continue
        merges += 1
        j = after[i]
        symbol = symbols[i] = made[r]
        symbols[j] = None
        pair[j] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            pair[i] = r = get(symbol << wide | symbols[k], -1)
            if r >= 0:
                heappush(heap, r << at | i)
        else:
            pair[i] = -1
        h = before[i]
        if h >= 0:
            pair[h] = r = get(symbols[h] << wide | symbol, -1)
            if r >= 0:
                heappush(heap, r << at | h)
    return symbols, merges


class _Memo(dict):
    def __init__(self, make, prefix: str, limit: int):
        super().__init__()
        self.make, self.prefix, self.limit = make, prefix, limit

    def __missing__(self, word: str):
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Irregular
        made = self.make(self.prefix + word)
        if len(word) <= LONGEST_MEMO:
            if len(self) >= self.limit:
                self.clear()
            self[word] = made
        return made


class ByteBpe:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str, memo: int = MEMO_WORDS):
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._library = ByteLevel(add_prefix_space=False, use_regex=True)
        shown = byte_alphabet()
        back = {c: b for b, c in shown.items()}
        self.byte_id = [vocab[shown[b]] for b in range(256)]
        self.wide = max(vocab.values()).bit_length()
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] << self.wide | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for s, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self._limit = memo
        self._id_pieces: dict[str, bytes] = {}
        self._n_pieces: dict[str, int] = {}
        self._ids = _Memo(self._encode_chunk, "", memo), _Memo(self._encode_chunk, " ", memo)
        self._counts = _Memo(self._count_chunk, "", memo), _Memo(self._count_chunk, " ", memo)
        self._line_ids = self._encode_chunk("\n")
        self._line_count = self._count_chunk("\n")

    # pieces -------------------------------------------------------------

    def _pieces(self, text: str) -> list[str]:
        """Pieces by the library's pattern."""
        if _BEYOND.search(text) is None:
            return _LATIN.findall(text)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def forget(self) -> None:
        """Empties the memos, so that an idle worker holds the vocabulary alone."""
        for memo in (self._id_pieces, self._n_pieces, *self._ids, *self._counts):
            memo.clear()

    def _keep(self, memo: dict, piece: str, made):
        if len(piece) <= LONGEST_MEMO:
            if len(memo) >= self._limit:
                memo.clear()
            memo[piece] = made
        return made

    def merged(self, piece: bytes) -> list[int]:
        ids, merges = merge([self.byte_id[b] for b in piece], self.ranks, self.made, self.wide)
        return [i for i in ids if i is not None] if merges else ids

    def _encode_chunk(self, text: str) -> bytes:
        memo, out = self._id_pieces, []
        for p in self._pieces(text):
            made = memo.get(p)
            if made is None:
                ids = self.merged(p.encode())
                made = self._keep(memo, p, pack(f"<{len(ids)}I", *ids))
            out.append(made)
        return b"".join(out)

    def _count_chunk(self, text: str) -> int:
        memo, n = self._n_pieces, 0
        for p in self._pieces(text):
            made = memo.get(p)
            if made is None:
                symbols = [self.byte_id[b] for b in p.encode()]
                made = self._keep(memo, p, len(symbols) - merge(symbols, self.ranks, self.made, self.wide)[1])
            n += made
        return n

    # texts --------------------------------------------------------------

    def encode(self, text: str | None) -> bytes:
        """Identifiers of a whole text, packed as little-endian u32."""
        return b"".join(self._over(text, self._encode_text, lambda i: i.to_bytes(4, "little"))) if text else b""

    def count(self, text: str | None) -> int:
        return sum(self._over(text, self._count_text, lambda i: 1)) if text else 0

    def _over(self, text: str, inner, special) -> list:
        if self._split_special is None or not (found := list(self._split_special.finditer(text))):
            return [inner(text)]
        out, at = [], 0
        for m in found:
            if m.start() > at:
                out.append(inner(text[at : m.start()]))
            out.append(special(self.special[m.group()]))
            at = m.end()
        if at < len(text):
            out.append(inner(text[at:]))
        return out

    def _encode_text(self, text: str) -> bytes:
        first, rest = self._ids[0], self._ids[1].__getitem__
        try:
            lines = []
            for line in text.split("\n"):
                words = iter(line.split(" "))
                lines.append(first[next(words)] + b"".join(map(rest, words)))
            return self._line_ids.join(lines)
        except _Irregular:
            return self._encode_chunk(text)

    def _count_text(self, text: str) -> int:
        first, rest = self._counts[0], self._counts[1].__getitem__
        try:
            lines = text.split("\n")
            n = (len(lines) - 1) * self._line_count
            for line in lines:
                words = iter(line.split(" "))
                n += first[next(words)] + sum(map(rest, words))
            return n
        except _Irregular:
            return self._count_chunk(text)

    def decode(self, ids) -> str:
        """Concatenate vocabulary strings; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_open: dict[tuple, ByteBpe] = {}


def opened(path: str) -> ByteBpe:
    """One vocabulary per Python worker."""
    if path not in _open:
        _open[path] = ByteBpe(path)
    return _open[path]


def _udf(fn, returns):
    """Arrow column function over batches, one Python loop per batch."""
    return F.arrow_udf(fn, returnType=returns)


def count_column(text: Column, path: str) -> Column:
    """Number of tokens, without making them."""

    def count(batch: pa.Array) -> pa.Array:
        bpe = opened(path)
        return pa.array([bpe.count(t) for t in batch.to_pylist()], pa.int64())

    return _udf(count, "long")(text)


def encode(df: DataFrame, path: str, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``n_tokens`` and ``ids``, packed as little-endian u32 so that a digest or a slice stays in the JVM; columns of these names are replaced."""

    def make(texts: pa.Array) -> list[pa.Array]:
        bpe = opened(path)
        ids = [bpe.encode(t) for t in texts.to_pylist()]
        return [pa.array([len(i) >> 2 for i in ids], pa.int64()), pa.array(ids, pa.binary())]

    return appended(df, make, text, "n_tokens long, ids binary", drop)


def decode(df: DataFrame, path: str, ids: str = "ids", drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``decoded``, the text of packed ids (null for null), replacing a column of that name."""

    def make(packed: pa.Array) -> list[pa.Array]:
        bpe = opened(path)
        return [pa.array([None if x is None else bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in packed.to_pylist()], pa.string())]

    return appended(df, make, ids, "decoded string", drop)


def count_tokens(df: DataFrame, path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """Adds ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens), replacing columns of these names."""
    return df.withColumn("n_tokens", count_column(F.col(text), path)).withColumn("over_limit", F.col("n_tokens") > limit)


def ids_array(ids: Column) -> Column:
    """Packed ids as array<int>."""

    def unpack(batch: pa.Array) -> pa.Array:
        return pa.array([None if x is None else np.frombuffer(x, "<u4").astype("i4") for x in batch.to_pylist()], pa.list_(pa.int32()))

    return _udf(unpack, "array<int>")(ids)


class FastByteBpe(ByteBpe):
    """The same vocabulary with tiktoken's merging of single pieces, for callers that need ids and not the method.

    Exact where merge ranks and ids rise together: two symbols that stand side by
    side once all lower ranks are merged are then the one listed pair of their
    concatenation.  Other vocabularies keep the heap.
    """

    def __init__(self, path: str, memo: int = MEMO_WORDS):
        super().__init__(path, memo)
        if all(a < b for a, b in zip([max(self.byte_id), *self.made], self.made)):
            import tiktoken

            ranks = {b: i for i, b in enumerate(self.bytes_of) if b and i <= self.made[-1]} if self.made else {}
            if len(ranks) == len(self.made) + 256:
                self.merged = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece


_fast: dict[str, FastByteBpe] = {}


def opened_fast(path: str) -> FastByteBpe:
    if path not in _fast:
        _fast[path] = FastByteBpe(path)
    return _fast[path]
