"""Exact removal of byte strings that also start in an earlier document (operator 6).

A string of ``LENGTH`` bytes is anchored at the least hash among its K-grams, so
equal strings have the same anchor at the same place wherever they are, and only
anchors (about one in 16 bytes) are exchanged, not positions.

1. The strings of an anchor are those that reach HALF bytes or more before it, and the
   rest; all of the former hold the HALF + K bytes around it, all of the latter the
   LENGTH - HALF + 1 bytes from it on.  These are the windows.  Chance
   repeats of windows in prose are much rarer than those of K-grams.  Of each window a
   short hash is sent, once a block of documents.  A window of one document only stays.
2. Of every other window the context is sent: the bytes of all its strings.  The
   contexts' suffixes from the anchor on are sorted by mergesort; a
   comparison finds the common extension by binary search over prefix polynomial
   hashes, so it takes a logarithm of its length.  Neighbours in that order are then
   compared byte by byte (should hashes have misled it, the part is sorted again by
   its bytes).  Runs of the order with a common extension and an equal left part are
   the equal strings; every string that is to go is compared byte by byte with that
   of the least document.
3. A window with very many different contexts (the edge of a passage in a third of all
   rows, each with other neighbours) is split by string: each string is a context of
   its own, sorted and compared in the same way, sent once a block.

Texts travel as compressed blocks of some megabytes, written once; a longer text is a
block of its own.  Anchors are found piece by piece.  Equal contexts within a block are
compared by their bytes there and sent once, however many documents share them, so what
a task gets of one window or string grows with the number of blocks, not of rows.  The
number of tasks grows with the texts, and a block sends a row to each task that it has
anything for: the rows grow as the texts times the tasks, which is why blocks are large.

Cases: null text is empty; texts shorter than LENGTH lose nothing; documents of
equal id don't cover one another; a null id comes before all others; strings
never cross documents and are judged on the input, not on what is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import words as W
from .tables import releasing, small_batches, written

LENGTH = 50
K = 20
SPAN = LENGTH - K + 1  # strings that one anchor can have, and K-grams in a string
HALF = SPAN // 2
BLOCK_BYTES = 8 << 20  # no more than an Arrow batch has
CHUNK_BYTES = 1 << 18  # of a block, hashed at once
TARGET_BYTES = 16 << 20  # of texts whose windows meet in one task
READ_BYTES = 64 << 20  # of texts that one task joins with what was found of them
PART = 20_000  # contexts sorted at once
ROWS = 64  # exchanged at once
HOT = 2_000
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """The first n powers of the hash base, modulo 2**64; enough for contexts, which are too short for texts built against it."""
    if len(own := _tables.get(base, W.BYTE_HASH[:0])) < n:
        made = np.full(1 << max(8, (n - 1).bit_length()), base, np.uint64)
        made[0] = 1
        own = _tables[base] = np.multiply.accumulate(made)
    return own[:n]


class Prefixes:
    """Prefix polynomial hashes of bytes; the hash of any substring in constant time."""

    def __init__(self, data: np.ndarray):
        self.data = data
        values = W.BYTE_HASH[data]
        values *= powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values, out=self.sums[1:])
        self.back = powers(len(data) + 1, _INVERSE)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def common(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at i and j, at most `most`, by binary search."""
        low, high = np.zeros(len(i), np.int64), most.astype(np.int64)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high + 1) >> 1
            same = self.hash(i, i + mid) == self.hash(j, j + mid)
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)


def suffix_sort(text: Prefixes, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes by group and then content: bottom-up mergesort whose comparisons are hash searches.

    Each round merges neighbouring runs of the same group: an element's place in
    the merged run is its place in its own run plus its rank in the other, found
    by binary search, for all elements at once.
    """
    order = np.argsort(group, kind="stable")
    at = X.runs(group[order])
    size = np.diff(at, append=len(order))
    first, n_own = np.repeat(at, size), np.repeat(size, size)  # of each place: its group's first place and size

    def less(a: np.ndarray, b: np.ndarray, equal: bool) -> np.ndarray:
        room = np.minimum(end[a] - start[a], end[b] - start[b])
        n = text.common(start[a], start[b], room)
        tie = n == room
        la, lb = end[a] - start[a], end[b] - start[b]
        next_a = text.data[np.minimum(start[a] + n, len(text.data) - 1)]
        next_b = text.data[np.minimum(start[b] + n, len(text.data) - 1)]
        return np.where(tie, (la < lb) | ((la == lb) & equal), next_a < next_b)

    width, largest = 1, int(size.max()) if len(size) else 0
    while width < largest:
        place = np.arange(len(order)) - first
        run = place // width
        sibling = first + (run ^ 1) * width
        stop = np.minimum(sibling + width, first + n_own)
        has = sibling < first + n_own
        low, high = np.where(has, sibling, 0), np.where(has, stop, 0)
        base = low.copy()
        left = run % 2 == 0
        active = np.flatnonzero(low < high)
        while len(active):
            mid = (low[active] + high[active]) >> 1
            other, own = order[mid], order[active]
            before = less(other, own, False)
            right = ~left[active]
            if right.any():  # equal elements of the left run come first
                before[right] = less(other[right], own[right], True)
            low[active] = np.where(before, mid + 1, low[active])
            high[active] = np.where(before, high[active], mid)
            active = active[low[active] < high[active]]
        pair = first + (run & ~1) * width
        merged = np.empty_like(order)
        merged[pair + (place % width) + (low - base)] = order
        order = merged
        width *= 2
    return order


def anchors(data: np.ndarray, borders: np.ndarray) -> dict[str, np.ndarray]:
    """Windows of a run of documents: document, key, span hash, anchor, first and last string start."""
    n = len(data)
    docs = np.flatnonzero(np.diff(borders) >= LENGTH)
    none = {f: np.zeros(0, t) for f, t in (("row", np.int64), ("key", np.uint64), ("span", np.uint64), ("at", np.int64), ("p1", np.int64), ("p2", np.int64))}
    if not len(docs):
        return none
    text = Prefixes(data)
    starts = np.arange(n - K + 1)
    gram = W.mix((text.sums[K:] - text.sums[: n - K + 1]) * text.back[: n - K + 1])
    least = (gram >> _U(32)) << _U(32) | starts.astype(np.uint64)
    # sliding minimum over SPAN places by doubling
    done, m = 1, least
    while done < SPAN:
        step = min(done, SPAN - done)
        m = np.minimum(m[: len(m) - step], m[step:])
        done += step
    # strings that lie within a document; all their K-grams do too
    valid = np.zeros(n + 1, np.int32)
    valid[borders[docs]] += 1
    valid[borders[docs + 1] - LENGTH + 1] -= 1
    p = np.flatnonzero(np.cumsum(valid)[: len(m)] > 0)
    if not len(p):
        return none
    at = (m[p] & _U(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    first = X.runs(at, row[p])
    p1, p2, at = p[first], p[np.append(first[1:], len(p)) - 1], at[first]
    before, after = np.flatnonzero(at - p1 >= HALF), np.flatnonzero(at - p2 < HALF)
    lead, tail = at[before], at[after]
    p1, p2 = np.concatenate([p1[before], np.maximum(p1[after], tail - HALF + 1)]), np.concatenate([np.minimum(p2[before], lead - HALF), p2[after]])
    key = np.concatenate([W.mix(text.hash(lead - HALF, lead + K) + W.STEPS[3]), W.mix(text.hash(tail, tail + LENGTH - HALF + 1) + W.STEPS[4])])
    at = np.concatenate([lead, tail])
    span = W.mix(text.hash(p1, p2 + LENGTH) + W.STEPS[1] * (at - p1).astype(np.uint64) + W.STEPS[2] * (p2 - p1).astype(np.uint64))
    return {"row": row[p1], "key": key, "span": span, "at": at, "p1": p1, "p2": p2}


def _pieces(borders: np.ndarray):
    """(first document, one after the last, first byte, one after the last) of what is hashed at once; pieces of a long text overlap."""
    i = 0
    while i < len(borders) - 1:
        j = max(i + 1, int(np.searchsorted(borders, borders[i] + CHUNK_BYTES, side="right")) - 1)
        a, z = int(borders[i]), int(borders[j])
        while z - a > CHUNK_BYTES + LENGTH:
            yield i, j, a, a + CHUNK_BYTES + LENGTH - 1
            a += CHUNK_BYTES
        yield i, j, a, z
        i = j


def _flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the bytes of segments, one after another."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + size, size)


class Block:
    """A block of documents, unpacked, with its windows."""

    def __init__(self, ids: bytes, lengths: bytes, text: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        self.borders = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, "<i8"))])
        self.data = np.frombuffer(zstandard.decompress(text, max_output_size=max(1, int(self.borders[-1]))), np.uint8) if self.borders[-1] else np.zeros(0, np.uint8)
        parts = [anchors(np.zeros(0, np.uint8), np.zeros(1, np.int64))]
        for i, j, a, z in _pieces(self.borders):
            made = anchors(self.data[a:z], np.clip(self.borders[i : j + 1] - a, 0, z - a))
            made["row"] += i
            for f in ("at", "p1", "p2"):
                made[f] += a
            parts.append(made)
        self.entry = {f: np.concatenate([p[f] for p in parts]) for f in parts[0]}
        self.doc = self.ids[self.entry["row"]]
        self.order = np.argsort(self.entry["key"])
        key = self.entry["key"][self.order]
        at = X.runs(key)
        size = np.diff(at, append=len(key))
        many = np.flatnonzero(np.repeat(size > 1, size))  # only these have an order by what follows the key
        own = self.order[many]
        self.order[many] = own[np.lexsort((self.entry["p1"][own], self.doc[own], self.entry["span"][own], self.entry["key"][own]))]
        self.group = np.empty(len(key), np.int64)  # of each entry: its window's number
        self.group[self.order] = np.repeat(np.arange(len(at)), size)
        doc = self.doc[self.order]
        new = np.ones(len(key), np.int64)
        new[1:] = self.entry["span"][self.order][1:] != self.entry["span"][self.order][:-1]
        some = len(at) > 0
        low, high = (np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)) if some else (doc, doc)
        new[at] = 1
        #: of each window: hash, how many contexts (at most 127), and 128 if more than one document has it
        self.grams = key[at], (np.minimum(np.add.reduceat(new, at) if some else new, 127) | np.where(high > low, 128, 0)).astype(np.uint8)

    def stand(self) -> None:
        """For each entry the first one of its block with the same bytes (``stands``); those of later documents are ``covered``."""
        e, order = self.entry, self.order
        at = X.runs(e["key"][order], e["span"][order])
        lead = np.empty(len(order), np.int64)
        lead[order] = order[np.repeat(at, np.diff(at, append=len(order)))]
        mine = np.flatnonzero(lead != np.arange(len(lead)))
        for k in range(0, len(mine), 1 << 14):
            own = mine[k : k + (1 << 14)]
            other = lead[own]
            size = e["p2"][own] - e["p1"][own] + LENGTH
            same = (e["p2"][other] - e["p1"][other] + LENGTH == size) & (e["at"][own] - e["p1"][own] == e["at"][other] - e["p1"][other])
            lead[own[~same]] = own[~same]
            own, other, size = own[same], other[same], size[same]
            if len(own):
                apart = self.data[_flat(e["p1"][own], size)] != self.data[_flat(e["p1"][other], size)]
                bad = np.add.reduceat(apart, np.cumsum(size) - size) > 0
                lead[own[bad]] = own[bad]
        self.stands, self.covered = lead, self.doc > self.doc[lead]

    @staticmethod
    def by_target(key: np.ndarray, entries: np.ndarray, n: int):
        """(target, entries) in a fixed order, so that replies need no names."""
        target = X.target_of(key[entries], n)
        order = np.argsort(target, kind="stable")
        target, entries = target[order], entries[order]
        at = X.runs(target)
        for t, a, b in zip(target[at].tolist(), at.tolist(), np.append(at[1:], len(target)).tolist()):
            yield t, entries[a:b]

    def codes(self, replies: list, n: int) -> np.ndarray:
        """First-round verdicts of the entries: 0 stays, 2 is to be sent as it is, 3 by string."""
        code = np.zeros(len(self.grams[0]), np.uint8)
        got = {r["target"]: r["reply"] for r in replies if r["round"] == 1}
        for t, own in self.by_target(self.grams[0], np.arange(len(code)), n):
            code[own] = np.frombuffer(zstandard.decompress(got[t]), np.uint8)
        return code[self.group]

    def contexts(self, own: np.ndarray) -> tuple[bytes, np.ndarray]:
        size = self.entry["p2"][own] - self.entry["p1"][own] + LENGTH
        return self.data[_flat(self.entry["p1"][own], size)].tobytes(), size

    def strings(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(entry, start, hash, the place of the first equal one by document) of every string of the entries."""
        size = self.entry["p2"][own] - self.entry["p1"][own] + 1
        of, start = np.repeat(own, size), _flat(self.entry["p1"][own], size)
        h = np.zeros(len(start), np.uint64)
        for a in range(0, len(start), 1 << 15):
            rows = self.data[start[a : a + (1 << 15), None] + np.arange(LENGTH)]
            h[a : a + (1 << 15)] = W.mix((W.BYTE_HASH[rows] * W.factors(LENGTH)).sum(1, dtype=np.uint64))
        order = np.lexsort((start, self.doc[of], h))
        at = X.runs(h[order])
        lead = np.empty(len(order), np.int64)
        lead[order] = order[np.repeat(at, np.diff(at, append=len(order)))]
        for a in range(0, len(start), 1 << 15):
            w = np.arange(a, min(a + (1 << 15), len(start)))
            same = (self.data[start[w][:, None] + np.arange(LENGTH)] == self.data[start[lead[w]][:, None] + np.arange(LENGTH)]).all(1)
            lead[w[~same]] = w[~same]
        return of, start, h, lead

    def left(self, begins: np.ndarray, ends: np.ndarray):
        """Rows of the documents without the bytes of the intervals."""
        order = np.argsort(begins, kind="stable")
        begins, ends = begins[order], np.maximum.accumulate(ends[order]) if len(order) else ends
        out = np.zeros(len(self.data), bool)
        new = np.flatnonzero(np.concatenate([[True], begins[1:] > ends[:-1]])) if len(begins) else np.zeros(0, np.int64)
        a, z = begins[new], ends[np.append(new[1:] - 1, len(ends) - 1)] if len(new) else ends
        out[_flat(a, z - a)] = True
        rows, names = [], (["doc_id", "n_bytes", "n_removed", "n_spans", "kept"], [*(pa.int64(),) * 4, pa.binary()])
        for k, doc in enumerate(self.ids.tolist()):
            a, z = self.borders[k], self.borders[k + 1]
            gone = out[a:z]
            removed = int(gone.sum())
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if removed else 0
            kept = (self.data[a:z][~gone] if removed else self.data[a:z]).tobytes()
            rows.append((None if doc == X.NULL_ID else doc, int(z - a), removed, spans, kept))
            if len(rows) == 256:
                yield _batch(rows, *names)
                rows = []
        if rows:
            yield _batch(rows, *names)


def _first_round(key: np.ndarray, about: np.ndarray, hot: int) -> np.ndarray:
    """Verdicts on the windows of all blocks; those of two blocks count as those of two documents, which the second round tells exactly."""
    order = np.argsort(key)
    at = X.runs(key[order])
    a, size = about[order], np.diff(at, append=len(key))
    many = (size > 1) | (np.maximum.reduceat(a, at) >= 128)
    contexts = np.add.reduceat((a & 127).astype(np.int64), at)
    out = np.empty(len(key), np.uint8)
    out[order] = np.repeat(np.where(many, np.where(contexts > hot, 3, 2), 0), size)
    return out


def _extensions(data: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Length of the common extension of the suffixes at a and b, at most ``room``, byte by byte."""
    out = room.astype(np.int64)
    for k in range(0, len(a), 1 << 12):
        w = slice(k, k + (1 << 12))
        columns = np.arange(int(room[w].max(initial=0)))
        inside = columns < room[w][:, None]
        last = len(data) - 1
        apart = (data[np.minimum(a[w][:, None] + columns, last)] != data[np.minimum(b[w][:, None] + columns, last)]) & inside
        some = apart.any(1)
        out[w] = np.where(some, apart.argmax(1) if len(columns) else 0, room[w])
    return out


def verified_order(text: Prefixes, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes by group and content, common extension of each with the next), true to the bytes whatever the hashes say."""
    order = suffix_sort(text, start, end, group)
    for last in (False, True):
        a, b = order[:-1], order[1:]
        la, lb = end[a] - start[a], end[b] - start[b]
        room = np.where(group[a] == group[b], np.minimum(la, lb), 0)
        shared = _extensions(text.data, start[a], start[b], room)
        top = len(text.data) - 1
        right = np.where(shared == room, la <= lb, text.data[np.minimum(start[a] + shared, top)] < text.data[np.minimum(start[b] + shared, top)])
        if last or (right | (group[a] != group[b])).all():
            return order, shared
        raw = text.data.tobytes()  # equal hashes of different bytes
        order = np.array(sorted(range(len(start)), key=lambda k: (group[k], raw[start[k] : end[k]])), np.int64)
    raise AssertionError


def covered_strings(data: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray, key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Bit masks: which of the strings of each context (by start) also start in a smaller document's."""
    mask = np.zeros(len(start), np.uint32)
    if len(start) < 2:
        return mask
    text = Prefixes(data)
    left = text.hash(start, start + anchor) + anchor.astype(np.uint64) * W.STEPS[0]
    first = np.lexsort((doc, left, key))  # the sort is stable, so equal contexts stay side by side, by document
    centre, end = (start + anchor)[first], (start + size)[first]
    order, shared = verified_order(text, centre, end, key[first])
    order = first[order]
    # equal contexts: the first stands for all, those of later documents go whole
    c, e, s = (start + anchor)[order], (start + size)[order], start[order]
    equal = (key[order][1:] == key[order][:-1]) & (shared == e[1:] - c[1:]) & (shared == e[:-1] - c[:-1]) & (anchor[order][1:] == anchor[order][:-1])
    some = np.flatnonzero(equal)
    equal[some] = _extensions(data, s[some], s[some + 1], anchor[order][some]) == anchor[order][some]
    head = np.flatnonzero(np.concatenate([[True], ~equal]))
    number = np.cumsum(np.concatenate([[True], ~equal])) - 1
    lead = order[head[number]]
    later = doc[order] > doc[lead]
    strings = (size[order] - LENGTH + 1).astype(np.uint64)
    mask[order[later]] = ((_U(1) << strings[later]) - _U(1)).astype(np.uint32)
    # among different contexts of a window, string by string
    shared = shared[head[1:] - 1]
    c, e, s, k, d, names = c[head], e[head], s[head], key[order][head], doc[order][head], order[head]
    near = np.concatenate([[False], k[1:] == k[:-1]]) | np.concatenate([k[1:] == k[:-1], [False]])
    found = np.zeros(len(head), np.uint32)
    for offset in range(SPAN):  # of the anchor within the string
        has = near & (c - offset >= s) & (c - offset + LENGTH <= e)
        own = np.flatnonzero(has)
        if len(own) < 2:
            continue
        run = np.cumsum(np.concatenate([[0], (shared < LENGTH - offset) | (k[1:] != k[:-1])]))
        left = text.hash(c[own] - offset, c[own])
        columns = np.arange(LENGTH) - offset
        for attempt in (0, 1):
            by = np.lexsort((d[own], left, run[own]))
            at = X.runs(run[own][by], left[by])
            lead = np.repeat(by[at], np.diff(at, append=len(by)))
            mine, other = own[by], own[lead]
            pick = np.flatnonzero(d[mine] > d[other])
            same = np.ones(len(pick), bool)
            for a in range(0, len(pick), 1 << 14):
                w = pick[a : a + (1 << 14)]
                same[a : a + (1 << 14)] = (data[c[mine[w]][:, None] + columns] == data[c[other[w]][:, None] + columns]).all(1)
            if same.all():
                break
            # equal hashes of different bytes: by the bytes themselves
            rows = np.ascontiguousarray(data[c[own][:, None] + columns]).view(f"V{LENGTH}").ravel()
            left = np.unique(rows, return_inverse=True)[1].astype(np.uint64)
        mine = mine[pick]
        np.bitwise_or.at(found, mine, np.uint32(1) << (c[mine] - offset - s[mine]).astype(np.uint32))
    mask[order[~later]] |= found[number[~later]]
    return mask


def covered_in_parts(data: np.ndarray, size: np.ndarray, anchor: np.ndarray, key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """``covered_strings`` of contexts that lie side by side, some whole groups at a time."""
    mask = np.zeros(len(key), np.uint32)
    start = np.cumsum(size) - size
    order = np.argsort(key, kind="stable")
    at = X.runs(key[order])
    k = 0
    while k < len(at):
        stop = max(k + 1, int(np.searchsorted(at, at[k] + PART, side="right")) - 1)
        own = order[at[k] : at[stop] if stop < len(at) else len(order)]
        ends = np.cumsum(size[own])
        mask[own] = covered_strings(data[_flat(start[own], size[own])], ends - size[own], size[own], anchor[own], key[own], doc[own])
        k = stop
    return mask


def _pack(values: np.ndarray, width: int = 8) -> bytes:
    """Integers as raw bytes of a width; wide ones as differences, compressed."""
    if width == 8:
        return zstandard.compress(np.diff(values, prepend=values.dtype.type(0)).tobytes(), 1)
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(raw: bytes, width: int = 8) -> np.ndarray:
    if width == 8:
        return np.cumsum(np.frombuffer(zstandard.decompress(raw), "<i8"))
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


_SENT = "target int, block long, kind int, a binary, b binary, c binary, d binary"
_REPLY = "block long, round int, target int, reply binary"


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def _batched(rows, names: list[str], kinds: list):
    """The rows in batches of at most ``ROWS``, or fewer of some megabytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if len(held) == ROWS or size > 4 << 20:
            yield _batch(held, names, kinds)
            held, size = [], 0
    if held:
        yield _batch(held, names, kinds)


_SENT_KINDS = ["target", "block", "kind", "a", "b", "c", "d"], [pa.int32(), pa.int64(), pa.int32(), *(pa.binary(),) * 4]
_REPLY_KINDS = ["block", "round", "target", "reply"], [pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def blocks(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(block, ids, lengths, text, n_bytes): documents packed and compressed, written once."""

    def pack(batches):
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = X.ids(batch.column(0))
            for first, data, borders in W.chunks(batch.column(1), BLOCK_BYTES):
                n = len(borders) - 1
                row = (task << 32 | k, ids[first : first + n].tobytes(), np.diff(borders).tobytes(), zstandard.compress(data.tobytes(), 3), len(data))
                yield _batch([row], ["block", "ids", "lengths", "text", "n_bytes"], [pa.int64(), *(pa.binary(),) * 3, pa.int64()])
                k += 1

    return written(df.select(F.col(id).cast("long"), text).mapInArrow(releasing(pack), "block long, ids binary, lengths binary, text binary, n_bytes long"), "texts")


def dedup_substrings(df: DataFrame, id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept), kept being the remaining bytes; a row per document.

    ``hot`` is the number of contexts above which a window is split by string; the result doesn't depend on it.
    """
    small_batches(df.sparkSession)
    packed = blocks(df, id, text)
    total = packed.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = X.targets(df.sparkSession)
    n = max(tasks, total // TARGET_BYTES)
    readers = max(tasks, total // READ_BYTES)

    def windows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r["ids"], r["lengths"], r["text"])
                key, about = b.grams
                for t, own in b.by_target(key, np.arange(len(key)), n):
                    yield t, r["block"], 1, _pack(key[own], 4), zstandard.compress(about[own].tobytes(), 1), None, None

    def send(batches):
        yield from _batched(windows(batches), *_SENT_KINDS)

    def decide(batches):
        names, keys, abouts = [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                names.append((r["block"], r["target"], len(r["a"]) // 4))
                keys.append(r["a"])
                abouts.append(zstandard.decompress(r["b"]))
        if not names:
            return
        key, about = np.frombuffer(b"".join(keys), "<u4"), np.frombuffer(b"".join(abouts), np.uint8)
        code = np.empty(len(key), np.uint8)
        target = np.repeat([t for _, t, _ in names], [size for *_, size in names])
        for t in np.unique(target):
            own = np.flatnonzero(target == t)
            code[own] = _first_round(key[own], about[own], hot)

        def replies():
            at = 0
            for block, t, size in names:
                yield block, 1, t, zstandard.compress(code[at : at + size].tobytes(), 3)
                at += size

        yield from _batched(replies(), *_REPLY_KINDS)

    first = written(X.exchanged(packed.mapInArrow(releasing(send), _SENT), n).mapInArrow(releasing(decide), _REPLY), "first")

    def joined(replies: DataFrame) -> DataFrame:
        lists = replies.repartition(readers, "block").groupBy("block").agg(F.collect_list(F.struct("round", "target", "reply")).alias("replies"))
        return packed.repartition(readers, "block").join(lists.hint("shuffle_hash"), "block", "left")

    def asked(b: Block, replies: list):
        """(kind, key, entries in the order sent, what strings there are): contexts (2) and single strings (3) of a block, by target."""
        code = b.codes(replies, n)
        b.stand()
        own = np.flatnonzero((code == 2) & (b.stands == np.arange(len(code))))
        apart = b.strings(np.flatnonzero((code == 3) & ~b.covered))
        return code, own, apart

    def contexts(batches):
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r["ids"], r["lengths"], r["text"])
                _, own, (of, start, h, lead) = asked(b, r["replies"] or [])
                e = b.entry
                for t, own in b.by_target(e["key"], own, n):
                    raw, size = b.contexts(own)
                    about = np.stack([size, e["at"][own] - e["p1"][own]]).astype(np.uint8)
                    yield t, r["block"], 2, _pack(e["key"][own], 5), about.tobytes(), _pack(b.doc[own]), zstandard.compress(raw, 1)
                for t, own in b.by_target(h, np.unique(lead), n):
                    about = np.stack([np.full(len(own), LENGTH), e["at"][of[own]] - start[own]]).astype(np.uint8)
                    raw = b.data[_flat(start[own], np.full(len(own), LENGTH))].tobytes()
                    yield t, r["block"], 3, _pack(h[own], 5), about.tobytes(), _pack(b.doc[of[own]]), zstandard.compress(raw, 1)

    def send_asked(batches):
        yield from _batched(contexts(batches), *_SENT_KINDS)

    def decide_asked(batches):
        names, parts = [], []
        for batch in batches:
            for r in batch.to_pylist():
                names.append((r["block"], r["target"], r["kind"]))
                size, anchor = np.frombuffer(r["b"], np.uint8).reshape(2, -1).astype(np.int64)
                raw = zstandard.decompress(r["d"], max_output_size=int(size.sum()))
                parts.append((_unpack(r["a"], 5) ^ _U(r["target"] << 40), size, anchor, _unpack(r["c"]), np.frombuffer(raw, np.uint8)))
        if not parts:
            return
        sizes = [len(p[0]) for p in parts]
        fields = [np.concatenate([p[k] for p in parts]) for k in range(5)]
        parts.clear()
        key, size, anchor, doc, data = fields
        mask = covered_in_parts(data, size, anchor, key, doc)

        def replies():
            at = 0
            for (block, t, kind), count in zip(names, sizes):
                yield block, kind, t, zstandard.compress(mask[at : at + count].tobytes(), 3)
                at += count

        yield from _batched(replies(), *_REPLY_KINDS)

    second = X.exchanged(joined(first).mapInArrow(releasing(send_asked), _SENT), n).mapInArrow(releasing(decide_asked), _REPLY)

    def remove(batches):
        for batch in batches:
            for r in batch.to_pylist():
                b, replies = Block(r["ids"], r["lengths"], r["text"]), r["replies"] or []
                code, sent, (of, start, h, lead) = asked(b, replies)
                e, got = b.entry, {(x["round"], x["target"]): x["reply"] for x in replies}
                begins, ends = [e["p1"][b.covered]], [e["p2"][b.covered] + LENGTH]
                mask = np.zeros(len(code), np.uint32)
                for t, own in b.by_target(e["key"], sent, n):
                    mask[own] = np.frombuffer(zstandard.decompress(got[2, t]), np.uint32)
                mask = np.where(b.covered, 0, mask[b.stands]).astype(np.uint32)
                some = np.flatnonzero(mask)
                for bit in range(SPAN if len(some) else 0):
                    own = some[mask[some] >> np.uint32(bit) & np.uint32(1) > 0]
                    begins.append(e["p1"][own] + bit)
                    ends.append(e["p1"][own] + bit + LENGTH)
                gone = np.zeros(len(h), bool)
                for t, own in b.by_target(h, np.unique(lead), n):
                    gone[own] = np.frombuffer(zstandard.decompress(got[3, t]), np.uint32) > 0
                own = start[gone[lead] | (b.doc[of] > b.doc[of[lead]])]
                begins.append(own)
                ends.append(own + LENGTH)
                yield from b.left(np.concatenate(begins), np.concatenate(ends))

    return joined(first.union(second)).mapInArrow(releasing(remove), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
