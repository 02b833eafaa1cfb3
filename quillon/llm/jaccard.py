"""N-gram Jaccard self-join with parity sketches (operator 5).

A document is the set of its distinct n-word shingles (64-bit hashes).  Documents
with equal sets are one class; classes are joined, copies are counted.

Two sets of sizes a <= b with Jaccard similarity t or more differ in at most
D = (a + b)(1 - t)/(1 + t) elements, and b <= a/t.  For each band of sizes a set
is XOR-hashed into a sketch of m = D + 1 + T blocks, each the XOR of the hashes
of its elements.  Where two blocks differ the sets do, so similar sets agree in
T + 1 blocks at least.  Blocks that hold nothing are not sent: a class with e of
them needs T + 1 - e common others, and that many are required of a pair before
it is verified.  A class with more than T empty blocks sends its least element
hashes instead (as many as a similar set can't all lack), so no link is lost.
A pair is looked for in the band of its smaller set only.

Most texts are like no other, and their blocks needn't travel.  A first pass sends the
least elements of each set, without its class: two similar sets have some of them in
common (``_least``).  A class with fewer that another class or batch has too is done;
one text of each other class goes on to the blocks.

Near copies agree in nearly all blocks, so their pairs would come up again and again.
Each class therefore has ``LABELS`` labels (a least element hash under a permutation),
which are sent as keys too and travel with its blocks: a pair of one label is made
where that label's classes meet, and nowhere else.  Sets carry their size on a scale,
and pairs of sizes too far apart end where they meet.  Sets of up to ``SMALL`` elements
also carry their size and a parity sketch of 64 bits, so short texts that share a
footer end as a refused pair in the task where they meet.  A bucket of more than
``BUCKET`` classes is cut into tiles of other tasks, which compare the parity sketches
of 1024 bits or twice the set's size and write the pairs that pass (a sketch folds to a smaller one).  What is left of the candidates is compared
by these sketches before whole sets follow.

Pairs that pass are verified on whole sets in tiles: neighbours are tiled by
their common least neighbour, at most about ``TILE`` classes a side, and a tile's
intersections are one matrix product, one tile in memory at a time.  Links are counted
with the sizes of the classes; copies are never expanded into pairs.

Cases: null, empty and blank texts have an empty set, no links and themselves as
component; fewer words than n make one shingle; a null id never names a
component (unless all ids in it are null); repeated rows are copies of one
another; rows of one id with different texts are documents of their own.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from math import ceil, floor

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from . import words as W
from .components import components
from .tables import appended, releasing, small_batches, written

TILE = 256
BUCKET = 512
CHUNK = 2_048  # classes on a side of a tile of a large bucket
SMALL = 100
LABELS = 2
KEY_BYTES = 4  # of a key, beside its target: a target holds about a million, so one key in some thousands meets another by chance
SKETCH_BITS = 1024  # at least; twice the set's size where that is more
TARGET_ELEMENTS = 1 << 21  # of the sets, about twice as many as their keys, whose blocks a task settles
SCALE = 1.04  # a step of the scale of sizes
ROWS = 2_000  # documents whose blocks are sent together
BLOOM_BITS = 1 << 23, 1 << 27  # least and most, by the number of classes
_U = np.uint64
_NEED = 15  # the low bits of a class id hold how many common blocks it needs
_FOUND = ["kind", "a", "b", "n", "members"]
_FIELDS = {"key": "<u8", "cls": "<u8"}
OWN, PROBE, LABEL = 0, 1, 2  # what a key is: a block of the set's band or a least hash, a block of a smaller band, the first label (then the next)
#: what a target gets of a class: id, labels, size (0: not small), size on the scale (0: unknown) and small sketch
_CLASS = np.dtype([("cls", "<u8"), ("label", "<u4", LABELS), ("size", "u1"), ("step", "u1"), ("small", "<u8")])


def shingles(texts: pa.Array, n: int = 5) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row of each element, element), sorted and distinct within a row, for each run of rows."""
    out = []
    for first, data, borders in W.chunks(texts):
        doc, _, _, h = W.words(data, borders, W.LOWER_HASH)
        at, g = W.grams(h, doc, n)
        rows, made = [doc[at]], [g]
        count = np.bincount(doc, minlength=len(borders) - 1)
        for k in range(1, n):  # the whole sequence where there are fewer words
            short = np.flatnonzero(count == k)
            if len(short):
                start = np.searchsorted(doc, short)
                total = np.full(len(short), _U(k)) * W.STEPS[7]
                for j in range(k):
                    total += h[start + j] * W.STEPS[j]
                rows.append(short)
                made.append(W.mix(total))
        row, g = np.concatenate(rows), np.concatenate(made)
        order = np.lexsort((g, row))
        row, g = row[order], g[order]
        at = X.runs(row, g)
        out.append((first, row[at], g[at]))
    return out


class Bands:
    """Size bands and, for each, the number of blocks; ``t`` is the least similarity."""

    def __init__(self, t: Fraction = Fraction(4, 5)):
        self.t = t
        lows, low = [], 1
        while low < 1 << 40:
            lows.append(low)
            low = max(low + 1, floor(low / t))
        self.lows = np.array(lows)
        most = [max(1, h - 1) for h in [*lows[1:], low]]
        differ = [int((a + floor(a / t)) * (1 - t) / (1 + t)) for a in most]
        self.extra = np.array([3 + ceil(0.05 * d) for d in differ])
        self.blocks = np.array(differ) + 1 + self.extra

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, side="right") - 1

    def least(self, sizes: np.ndarray) -> np.ndarray:
        """The band of the smallest set that may be similar."""
        return self.of(np.array([max(1, ceil(int(n) * self.t)) for n in sizes], np.int64) if len(sizes) else sizes)

    def prefix(self, n: int) -> int:
        return n - ceil(n * self.t) + 1


def _set_hash(element: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return W.mix(np.add.reduceat(W.mix(element + W.STEPS[6]), starts) + sizes.astype(np.uint64))


def _same_class(element: np.ndarray, cls: int) -> bool:
    """Whether the elements are the set of the class, by all bits but those of what it needs."""
    high = int(_set_hash(element, np.zeros(1, np.int64), np.array([len(element)]))[0]) & ~_NEED
    return (high or 16) == cls & ~_NEED & (1 << 64) - 1


def sketches(row: np.ndarray, element: np.ndarray, n_rows: int, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class id of each row or 0 for empty sets, key, class id of each key)."""
    cls, key, owner, _ = _sketched(row, element, n_rows, bands)
    return cls, key, cls[owner]


def _sketched(row: np.ndarray, element: np.ndarray, n_rows: int, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class id of each row, key, row of each key, OWN or PROBE)."""
    sizes = np.bincount(row, minlength=n_rows)
    ends = np.cumsum(sizes)
    cls = np.zeros(n_rows, np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return cls, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    cls[full] = _set_hash(element, (ends - sizes)[full], sizes[full])
    low, high = np.zeros(n_rows, np.int64), np.full(n_rows, -1)
    low[full], high[full] = bands.least(sizes[full]), bands.of(sizes[full])
    need = np.full(n_rows, _NEED)
    keys, owners, kinds = [], [], []
    hashed = W.mix(element + W.STEPS[5]) >> _U(32)
    many = np.zeros(n_rows, bool)
    for step in range(int((high - low)[full].max()) + 1):
        band = low + step
        mine = (band <= high) & (sizes > 0)
        m = np.where(mine, bands.blocks[np.maximum(band, 0)], 0)
        base = np.cumsum(m) - m
        total = int(m.sum())
        own = mine[row]
        r = row[own]
        block = (hashed[own] * m[r].astype(np.uint64) >> _U(32)).astype(np.int64)
        at = base[r] + block
        value = np.zeros(total, np.uint64)
        np.bitwise_xor.at(value, at, element[own])
        used = np.bincount(at, minlength=total) > 0
        of = np.repeat(np.arange(n_rows), m)
        empty = m - np.bincount(of[used], minlength=n_rows)
        extra = bands.extra[np.maximum(band, 0)]
        need = np.where(mine, np.minimum(need, extra + 1 - empty), need)
        many |= mine & (empty > extra)
        number = (np.arange(total) - base[of]).astype(np.uint64)
        key = W.mix(value + W.STEPS[0] * (number + _U(1)) + W.STEPS[1] * (band[of] + 1).astype(np.uint64))
        keys.append(key[used])
        owners.append(of[used])
        kinds.append(np.where(band == high, OWN, PROBE)[of[used]])
    for r in np.flatnonzero(many):
        start = ends[r] - sizes[r]
        own = element[start : start + bands.prefix(int(sizes[r]))]  # elements are sorted, so these are the least
        keys.append(W.mix(own + W.STEPS[4]))
        owners.append(np.full(len(own), r))
        kinds.append(np.full(len(own), OWN))
    need = np.clip(need, 1, _NEED).astype(np.uint64)
    cls[full] = (cls[full] & ~_U(_NEED)) | need[full]
    cls[full[cls[full] < 16]] += _U(16)
    return cls, np.concatenate(keys), np.concatenate(owners), np.concatenate(kinds).astype(np.uint8)


def _labels(element: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Labels of sets that start there, 32 bits each."""
    return np.stack([(W.mix(np.minimum.reduceat(W.mix(element ^ W.STEPS[k]), starts)) >> _U(32)).astype(np.uint32) for k in range(LABELS)], 1)


def _shared(sizes: np.ndarray, t: Fraction) -> np.ndarray:
    """How many of its least elements the first pass asks of a set of these sizes and a similar one as large or larger; it grows with the size."""
    return np.minimum(1 + sizes // 10, -(-sizes * t.numerator // t.denominator))


def _least(sizes: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(how many least elements sets send in the first pass, how many of them a similar set sends too).

    Similar sets have ceil(n t) elements in common at least, so the first k of these
    are among the n - ceil(n t) + k least of either.  The other may have only n t elements.
    """
    common = -(-sizes * t.numerator // t.denominator)
    return sizes - common + _shared(sizes, t), _shared(common, t)


def _steps(sizes: np.ndarray) -> np.ndarray:
    """Sizes on the scale, from 1; the largest share its end."""
    return np.where(sizes > 0, np.minimum(1 + np.floor(np.log(np.maximum(sizes, 1)) / np.log(SCALE)), 255), 0).astype(np.uint8)


def _small_parity(row: np.ndarray, element: np.ndarray, n_rows: int) -> np.ndarray:
    """Parity sketches of 64 bits."""
    out = np.zeros(n_rows, np.uint64)
    np.bitwise_xor.at(out, row, _U(1) << (W.mix(element + W.STEPS[3]) & _U(63)))
    return out


def _pairs_of_buckets(key: np.ndarray, cls: np.ndarray, wanted=None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(one, other) entry of all wanted pairs of the buckets of up to BUCKET classes, and the entries of larger buckets."""
    order = np.lexsort((cls, key))
    order = order[X.runs(key[order], cls[order])]
    at = X.runs(key[order])
    size = np.diff(at, append=len(order))
    left, right, large = [], [], []
    for z in np.unique(size[size > 1]):
        starts = at[size == z]
        if z > BUCKET:
            large += [order[s : s + z] for s in starts]
            continue
        i, j = np.triu_indices(int(z), 1)
        some = max(1, (1 << 19) // len(i))
        for k in range(0, len(starts), some):
            own = starts[k : k + some, None]
            x, y = order[(own + i).ravel()], order[(own + j).ravel()]
            good = wanted(x, y) if wanted else slice(None)
            left.append(x[good])
            right.append(y[good])
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none]), large


def _wanted(x: np.ndarray, y: np.ndarray, fx: np.ndarray, fy: np.ndarray, t: Fraction) -> np.ndarray:
    """Which pairs of class records are made where keys of these kinds meet."""
    good = (fx == fy) | (fx < LABEL) & (fy < LABEL)
    good &= (fx != PROBE) | (fy != PROBE)
    for k in range(LABELS):  # a pair of one label is made at that label
        good &= (x["label"][:, k] != y["label"][:, k]) | (fx >= LABEL) & (fx <= LABEL + k)
    a, b = x["step"].astype(np.int64), y["step"].astype(np.int64)
    good &= (a == 0) | (b == 0) | (np.abs(a - b) < 2 + np.log(float(1 / t)) / np.log(SCALE))
    a, b = x["size"].astype(np.int64), y["size"].astype(np.int64)
    apart = np.bitwise_count(x["small"] ^ y["small"]).astype(np.int64)
    good &= (a == 0) | (b == 0) | ((t.denominator + t.numerator) * apart <= (t.denominator - t.numerator) * (a + b)) & (t.denominator * np.minimum(a, b) >= t.numerator * np.maximum(a, b))
    return good


def _counted(one: np.ndarray, other: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    left, right = np.minimum(one, other), np.maximum(one, other)
    order = np.lexsort((right, left))
    left, right, times = left[order], right[order], times[order]
    at = X.runs(left, right)
    n = np.add.reduceat(times, at) if len(at) else times
    return pa.RecordBatch.from_arrays([pa.array(left[at].view(np.int64)), pa.array(right[at].view(np.int64)), pa.array(n.astype(np.int32))], ["a", "b", "n"])


def _bloom(values: DataFrame) -> np.ndarray:
    """A filter of 16 bits a value, within BLOOM_BITS (so it may be broadcast, whatever the data), of a long column; false hits only cost time."""
    bits = min(max(BLOOM_BITS[0], 1 << (16 * values.count()).bit_length()), BLOOM_BITS[1])

    def part(batches):
        seen = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for h in _bloom_places(batch.column(0).to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(seen, h >> 3, (1 << (h & 7)).astype(np.uint8))
        used = np.flatnonzero(seen.reshape(-1, 1024).any(1))
        for k in used:
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([seen[1024 * k : 1024 * (k + 1)].tobytes()], pa.binary())], ["k", "bits"])

    def merged(batches):
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(raw, np.uint8)
                seen[k] = own | seen[k] if k in seen else own
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([v.tobytes() for v in seen.values()], pa.binary())], ["k", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    for r in values.mapInArrow(releasing(part), "k int, bits binary").repartition(8, "k").mapInArrow(releasing(merged), "k int, bits binary").collect():
        out[1024 * r["k"] : 1024 * (r["k"] + 1)] = np.frombuffer(r["bits"], np.uint8)
    return out


def _bloom_places(values: np.ndarray, bits: int) -> list[np.ndarray]:
    h = W.mix(values.astype(np.int64).view(np.uint64) + W.STEPS[3])
    return [(h & _U(bits - 1)).astype(np.int64), (h >> _U(32) & _U(bits - 1)).astype(np.int64)]


def _tile_links(sets: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray, t: Fraction) -> np.ndarray:
    """Which of the pairs of classes are similar, on whole sets."""
    names = np.array(sorted(sets))
    sizes = np.array([len(sets[c]) for c in names.tolist()])
    values = np.concatenate([sets[c] for c in names.tolist()])
    owner = np.repeat(np.arange(len(names)), sizes)
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    own = shared[column]
    owner, column = owner[own], place[column[own]]
    common = np.zeros((len(names), len(names)), np.float32)
    width = 4096
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [start, start + width])
        m = np.zeros((len(names), width), np.float32)
        m[owner[lo:hi], column[lo:hi] - start] = 1
        common += m @ m.T
    i, j = np.searchsorted(names, a), np.searchsorted(names, b)
    both = common[i, j].astype(np.int64)
    return t.denominator * both >= t.numerator * (sizes[i] + sizes[j] - both)


def _compact(key: np.ndarray, owner: np.ndarray, kind: np.ndarray, records: np.ndarray, targets: int):
    """Blobs of KEY_BYTES a key (the target is known too; a chance meeting is one more pair to check), runs of one class and kind, and the classes."""
    target = X.target_of(key, targets)
    order = np.lexsort((key, kind, owner, target))
    key, owner, kind, target = key[order], owner[order], kind[order], target[order]
    at = X.runs(target)
    for t, a, z in zip(target[at].tolist(), at.tolist(), np.append(at[1:], len(target)).tolist()):
        first = X.runs(owner[a:z], kind[a:z])
        who, of = np.unique(owner[a:z][first], return_inverse=True)
        steps = np.diff(of, prepend=0).astype(np.uint8)  # 0 or 1
        times = np.diff(first, append=z - a).astype("<u4")
        raw = b"".join((np.array([len(who), len(first)], "<u4").tobytes(), steps.tobytes(), kind[a:z][first].tobytes(), times.tobytes(), *(records[f][who].tobytes() for f in _CLASS.names[:-1]), records["small"][who[records["size"][who] > 0]].tobytes()))
        low = np.ascontiguousarray(key[a:z]).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
        yield pa.RecordBatch.from_arrays(
            [pa.array([t], pa.int32()), pa.array([0], pa.int32()), pa.array([low.tobytes()], pa.binary()), pa.array([zstandard.compress(raw, 1)], pa.binary())],
            ["target", "kind", "key", "cls"],
        )


def _expanded(key: bytes, packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low bits of the keys, number of each key's class, kind of each key, class records)."""
    low = np.zeros((len(key) // KEY_BYTES, 8), np.uint8)
    low[:, :KEY_BYTES] = np.frombuffer(key, np.uint8).reshape(-1, KEY_BYTES)
    raw, at = zstandard.decompress(packed), 8

    def take(dtype, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, dtype, n, at)
        at += out.nbytes
        return out

    classes, runs = np.frombuffer(raw, "<u4", 2).tolist()
    of, kind, times = np.cumsum(take("u1", runs).astype(np.int64)), take("u1", runs), take("<u4", runs).astype(np.int64)
    records = np.zeros(classes, _CLASS)
    records["cls"] = take("<u8", classes)
    records["label"] = take("<u4", classes * LABELS).reshape(-1, LABELS)
    records["size"] = take("u1", classes)
    records["step"] = take("u1", classes)
    small = np.flatnonzero(records["size"])
    records["small"][small] = take("<u8", len(small))
    return low.view("<u8").ravel(), np.repeat(of, times), np.repeat(kind, times), records


def _first_rows(df: DataFrame, id: str, text: str, n: int, bands: Bands, targets: int) -> DataFrame:
    """Blobs of least elements (kind 0: cls holds the batch, then its classes by number and how many keys each has there), documents (kind 1: key holds the sets' sizes) and a batch's classes (kind 2)."""

    def spread(batches):
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            ids = X.ids(batch.column(0))
            cls, sizes = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.int64)
            keys, owners = [], []
            for first, row, element in shingles(batch.column(1), n):
                rows = int(row[-1]) + 1 if len(row) else 0
                size = np.bincount(row, minlength=rows)
                cls[first : first + rows], sizes[first : first + rows] = sketches(row, element, rows, bands)[0], size
                sent = np.arange(len(row)) - (np.cumsum(size) - size)[row] < _least(size, bands.t)[0][row]  # elements are sorted
                keys.append(W.mix(element[sent] + W.STEPS[6]))
                owners.append(row[sent] + first)
            home = (int(ids[0]) * 0x9E3779B97F4A7C15 >> 33) % targets if len(ids) else 0
            out = [(home, 1, sizes.astype("<i8").tobytes(), np.stack([cls.view(np.int64), ids]).tobytes())]
            known, head, of = np.unique(cls, return_index=True, return_inverse=True)
            if keys:
                key, owner = np.concatenate(keys), np.concatenate(owners)
                once = head[of[owner]] == owner
                key, owner = key[once], of[owner[once]]
                order = np.argsort(key)  # what several classes of the batch have is counted here, and sent once in no class's name
                at = X.runs(key[order])
                size = np.diff(at, append=len(order))
                within = np.bincount(owner[order[np.repeat(size > 1, size)]], minlength=len(known))
                owner[order[at[size > 1]]] = ROWS
                key, owner = key[order[at]], owner[order[at]]
                target = X.target_of(key, targets)
                order = np.lexsort((owner, target))
                key, owner, target = key[order], owner[order], target[order]
                name = hashlib.blake2b(known.tobytes(), digest_size=8).digest()
                at = X.runs(target)
                for to, start, end in zip(target[at].tolist(), at.tolist(), np.append(at[1:], len(target)).tolist()):
                    run = X.runs(owner[start:end])
                    low = np.ascontiguousarray(key[start:end]).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
                    raw = owner[start:end][run].astype("<u2").tobytes() + np.diff(run, append=end - start).astype("<u4").tobytes()
                    out.append((to, 0, low.tobytes(), name + zstandard.compress(raw, 1)))
                out.append((home, 2, name, np.concatenate([known.view(np.int64), sizes[head], within]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["target", "kind", "key", "cls"])

    return df.select(F.col(id).cast("long"), text).mapInArrow(releasing(spread), X.schema(_FIELDS))


def _first_settled(batches):
    """Rows of documents (kind 0), of batches' classes (kind 2) and of how many of a batch's keys of each class are elsewhere too (kind 1)."""
    keys, owners, names = [], [], []
    for batch in batches:
        for target, kind, key, cls in zip(*(batch.column(c).to_pylist() for c in ("target", "kind", "key", "cls"))):
            if kind == 0:
                raw = zstandard.decompress(cls[8:])
                many = len(raw) // 6
                who, times = np.frombuffer(raw, "<u2", many), np.frombuffer(raw, "<u4", many, 2 * many)
                low = np.zeros((len(key) // KEY_BYTES, 8), np.uint8)
                low[:, :KEY_BYTES] = np.frombuffer(key, np.uint8).reshape(-1, KEY_BYTES)
                keys.append(low.view("<u8").ravel() ^ _U(target << 40))
                owners.append(np.repeat(who.astype(np.int32) + len(names) * (ROWS + 1), times))
                names.append(int.from_bytes(cls[:8], "little", signed=True))
            elif kind == 1:
                size = np.frombuffer(key, "<i8")
                c, ids = np.frombuffer(cls, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int32)), pa.array(c), X.id_array(ids), pa.array(size.astype(np.int32)), pa.nulls(len(ids), pa.binary())], _FOUND)
            else:
                yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([int.from_bytes(key, "little", signed=True)]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([cls], pa.binary())], _FOUND)
    if not keys:
        return
    key, owner = np.concatenate(keys), np.concatenate(owners)
    keys.clear()
    owners.clear()
    order = np.argsort(key)
    at = X.runs(key[order])
    size = np.diff(at, append=len(order))
    who, times = np.unique(owner[order[np.repeat(size > 1, size)]], return_counts=True)
    some = who % (ROWS + 1) < ROWS
    who, times = who[some], times[some]
    of = who // (ROWS + 1)
    at = X.runs(of)
    for k, start, end in zip(of[at].tolist(), at.tolist(), np.append(at[1:], len(of)).tolist()):
        raw = (who[start:end] % (ROWS + 1)).astype("<u2").tobytes() + times[start:end].astype("<u4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([names[k]]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([raw], pa.binary())], _FOUND)


def _with_company(found: DataFrame, targets: int, t: Fraction) -> DataFrame:
    """(cls, n) of the classes with as many keys that are elsewhere too as a similar set would have."""

    def counted(batches):
        for _, own in _by_tile(batches):
            known = next((raw for _, kind, raw in own if kind == 2))
            cls, size, n = np.frombuffer(known, "<i8").reshape(3, -1).copy()
            for _, kind, raw in own:
                if kind == 1:
                    many = len(raw) // 6
                    n[np.frombuffer(raw, "<u2", many)] += np.frombuffer(raw, "<u4", many, 2 * many)
            good = (size > 0) & (n >= _least(size, t)[1])
            yield pa.RecordBatch.from_arrays([pa.array(cls[good]), pa.array(size[good])], ["cls", "n"])

    rows = found.where("kind > 0").select("a", "kind", "members").repartition(targets, "a").sortWithinPartitions("a")
    return rows.mapInArrow(releasing(counted), "cls long, n long").dropDuplicates(["cls"])


def _likely(batch: pa.RecordBatch, bloom: np.ndarray) -> pa.RecordBatch:
    """The rows whose id, in the first column, is in the filter."""
    hit = np.ones(batch.num_rows, bool)
    for h in _bloom_places(X.ids(batch.column(0)), 8 * len(bloom)):
        hit &= (bloom[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)
    return batch.filter(pa.array(hit))


def _gathered(batches):
    """Batches of ROWS rows, or a few more, that hold copies."""
    own, many = [], 0
    for batch in batches:
        if batch.num_rows:
            own.append(batch)
            many += batch.num_rows
        if many >= ROWS:
            yield pa.concat_batches(own)
            own, many = [], 0
    if own:
        yield pa.concat_batches(own)


def _class_rows(df: DataFrame, id: str, text: str, n: int, bands: Bands, targets: int, bloom: np.ndarray) -> DataFrame:
    """Blobs of keys (kind 0) and sketches (kind 2) by target, of the documents whose id is in the filter."""

    def spread(batches):
        for batch in (b.slice(k, ROWS) for b in _gathered(_likely(b, bloom) for b in batches) for k in range(0, b.num_rows, ROWS)):
            records = np.zeros(batch.num_rows, _CLASS)
            keys, owners, kinds = [], [], []
            parities: dict[int, bytes] = {}
            for first, row, element in shingles(batch.column(1), n):
                rows = int(row[-1]) + 1 if len(row) else 0
                cls, key, owner, kind = _sketched(row, element, rows, bands)
                size = np.bincount(row, minlength=rows)
                full, own = np.flatnonzero(size), records[first : first + rows]
                own["cls"], own["step"] = cls, _steps(size)
                small = size <= SMALL
                own["size"] = np.where(small, size, 0)
                own["small"] = np.where(small & (size > 0), _small_parity(row, element, rows), 0)
                label = _labels(element, (np.cumsum(size) - size)[full]) if len(full) else np.zeros((0, LABELS), np.uint32)
                own["label"][full] = label
                for k in range(LABELS):
                    keys.append(W.mix(label[:, k].astype(np.uint64) + W.STEPS[2] * _U(k + 1)))
                    owners.append(full + first)
                    kinds.append(np.full(len(full), LABEL + k, np.uint8))
                keys.append(key)
                owners.append(owner + first)
                kinds.append(kind)
                for r, start, end in _slices(row):
                    if int(cls[r]) not in parities:
                        parities[int(cls[r])] = _parity(element[start:end], _width(end - start))
            if not keys:
                continue
            key, owner, kind = np.concatenate(keys), np.concatenate(owners), np.concatenate(kinds)
            _, head, of = np.unique(records["cls"], return_index=True, return_inverse=True)
            once = head[of[owner]] == owner  # copies within the batch send their blocks once
            yield from _compact(key[once], owner[once], kind[once], records, targets)
            home = int(records["cls"][0] >> _U(33)) % targets
            for width in {len(p) for p in parities.values()}:
                own = {c: p for c, p in parities.items() if len(p) == width}
                yield pa.RecordBatch.from_arrays([pa.array([home], pa.int32()), pa.array([2], pa.int32()), pa.array([np.array(list(own), np.uint64).tobytes()], pa.binary()), pa.array([b"".join(own.values())], pa.binary())], ["target", "kind", "key", "cls"])

    return df.select(F.col(id).cast("long"), text).mapInArrow(releasing(spread), X.schema(_FIELDS))


def join(df: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, t: Fraction = Fraction(4, 5)) -> dict[str, DataFrame]:
    """``documents`` (doc_id, n_shingles, cls), ``classes`` (cls, copies, rep) and ``links`` (a, b) between classes, each pair once."""
    spark: SparkSession = df.sparkSession
    small_batches(spark)
    targets = X.targets(spark, df)
    bands = Bands(t)

    # documents and what is known of their classes' keys come out of one pass, told apart by kind
    first = X.exchanged(_first_rows(df, id, text, n, bands, targets), targets).mapInArrow(releasing(_first_settled), "kind int, a long, b long, n int, members binary")
    first = written(first, "first")
    documents = first.where("kind = 0").select(F.col("b").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("a")).alias("cls"))
    classes = written(documents.where("cls is not null").groupBy("cls").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep")), "classes")
    going = written(_with_company(first, targets, t).join(classes, "cls").select(F.coalesce("rep", F.lit(X.NULL_ID)).alias("rep"), "n"), "going")
    going_bloom = _bloom(going.select("rep"))
    few = min(targets, max(spark.sparkContext.defaultParallelism, (going.agg(F.sum("n")).first()[0] or 0) // TARGET_ELEMENTS))

    # sketches and candidate counts come out of one pass, too
    def settle(batches):
        keys, owners, kinds, tables, known = [], [], [], [], 0
        for batch in batches:
            for target, kind, key, cls in zip(*(batch.column(c).to_pylist() for c in ("target", "kind", "key", "cls"))):
                if kind == 0:
                    low, own, what, records = _expanded(key, cls)
                    keys.append(low ^ _U(target << 40))
                    owners.append((own + known).astype(np.int32))
                    kinds.append(what)
                    tables.append(records)
                    known += len(records)
                else:
                    c = np.frombuffer(key, "<i8")
                    width = len(cls) // max(1, len(c))
                    own = [cls[k * width : (k + 1) * width] for k in range(len(c))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), 3, np.int32)), pa.array(c), pa.nulls(len(c), pa.int64()), pa.nulls(len(c), pa.int32()), pa.array(own, pa.binary())], _FOUND)
        if not keys:
            return
        key, own, kind, table = np.concatenate(keys), np.concatenate(owners), np.concatenate(kinds), np.concatenate(tables)
        for parts in (keys, owners, kinds, tables):
            parts.clear()
        cls = table["cls"][own]
        left, right, large = _pairs_of_buckets(key, cls, lambda x, y: _wanted(table[own[x]], table[own[y]], kind[x], kind[y], t))
        if len(left):
            made = _counted(cls[left], cls[right], np.where(kind[left] >= LABEL, _NEED, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(made), np.int32)), *made.columns, pa.nulls(len(made), pa.binary())], _FOUND)
        for entries in large:  # its tiles go to other tasks, a row for each side; pairs of one label are made at the label
            if kind[entries[0]] < LABEL and any((x == x[0]).all() for x in table["label"][own[entries]].T):
                continue
            parts = -(-len(entries) // CHUNK)
            name = int(W.mix(key[entries[:1]] + cls[entries[:1]]).view(np.int64)[0])
            for k in range(parts):
                some = entries[k * CHUNK : (k + 1) * CHUNK]
                yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([name]), pa.array([parts]), pa.array([k], pa.int32()), pa.array([_tail(table[own[some]], kind[some])], pa.binary())], _FOUND)

    found = X.exchanged(_class_rows(df, id, text, n, bands, few, going_bloom), few).mapInArrow(releasing(settle), "kind int, a long, b long, n int, members binary")
    found = written(found, "blocks")

    sketch = found.where("kind = 3").select(F.col("a").alias("cls"), F.col("members").alias("s")).dropDuplicates(["cls"])
    needed = F.greatest(F.col("a").bitwiseAND(_NEED), F.col("b").bitwiseAND(_NEED))
    counted = found.where("kind = 1").select("a", "b", "n")
    pairs = written(counted.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= needed).select("a", "b"), "pairs")

    # a wide sketch of each set goes first: most pairs that are not similar end there, and whole sets needn't follow
    @F.arrow_udf("boolean")
    def may_be_similar(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(_alike(x.to_pylist(), y.to_pylist(), t))

    met = pairs.join(sketch.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a").join(sketch.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b")
    close = met.where(may_be_similar("sa", "sb")).select("a", "b")
    large = found.where("kind = 2")
    if large.head(1):
        close = close.union(_tiled(large, sketch, targets, t)).distinct()
    close = written(close, "close")

    # whole sets of one document of each class that still has a candidate, straight to its tiles
    placed, wanted = _tiles(close)
    members = wanted.groupBy("cls").agg(F.collect_list("tile").alias("tiles"))
    chosen = written(members.join(classes, "cls").select("cls", "rep", "tiles"), "chosen")
    bloom = _bloom(chosen.where("rep is not null").select("rep"))

    def likely(batches):
        for batch in batches:
            yield _likely(batch, bloom)

    texts = df.select(F.col(id).cast("long").alias("rep"), F.col(text).alias("text")).where("rep is not null")
    texts = texts.mapInArrow(releasing(likely), "rep long, text string").join(chosen.where("rep is not null").hint("shuffle_hash"), "rep")
    texts = texts.select("cls", "text", "tiles").union(_nameless(df, id, text, chosen, n, bands))

    def whole(batches):
        for batch in batches:
            cls, tiles = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for first, row, element in shingles(batch.column(1), n):
                for r, start, end in _slices(row):
                    if not _same_class(element[start:end], int(cls[first + r])):
                        continue  # another text of the same id
                    own = tiles[first + r].as_py()
                    made = [pa.array(own, pa.int64()), pa.array([int(cls[first + r])] * len(own)), pa.array([element[start:end].tobytes()] * len(own), pa.binary())]
                    yield pa.RecordBatch.from_arrays(made, ["tile", "cls", "payload"])

    def near_sets(payload: dict[int, bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _tile_links({c: np.frombuffer(x, "<u8") for c, x in payload.items()}, a, b, t)

    sets = texts.mapInArrow(releasing(whole), "tile long, cls long, payload binary")
    return {"documents": documents, "classes": classes, "links": written(_judged(placed, sets, near_sets, targets), "links")}


def _parity(elements: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """The set's size and the parity of the elements that hash to each of the bits; the Hamming distance of two never exceeds the symmetric difference."""
    odd = np.bincount((W.mix(elements + W.STEPS[2]) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.uint64(len(elements)).tobytes() + np.packbits(odd.astype(np.uint8)).tobytes()


def _width(size: int) -> int:
    """Bits of the sketch of a set: sketches of fewer bits than elements that differ tell nothing."""
    return max(SKETCH_BITS, 1 << (2 * size - 1).bit_length())


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """Sketches as they would be with fewer bits."""
    while sketch.shape[-1] > words + 1:
        half = sketch.shape[-1] // 2
        sketch = np.concatenate([sketch[..., :1], sketch[..., 1 : half + 1] ^ sketch[..., half + 1 :]], -1)
    return sketch


def _alike(one: list[bytes], other: list[bytes], t: Fraction) -> np.ndarray:
    """Whether the sketches of each pair, of any widths, may be of similar sets."""
    width = np.array([[len(x), len(y)] for x, y in zip(one, other)], np.int64).reshape(-1, 2)
    good = np.zeros(len(one), bool)
    for a, b in np.unique(width, axis=0).tolist():
        at = np.flatnonzero((width == (a, b)).all(1))
        words = min(a, b) // 8 - 1
        good[at] = _near(*(_folded(np.frombuffer(b"".join(v[k] for k in at.tolist()), "<u8").reshape(len(at), -1), words) for v in (one, other)), t)
    return good


def _tiles(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tile, a, b) of every pair, written, and (tile, cls) of every class that a tile needs.

    A class is tiled by the least of its neighbours' least neighbours, which nearly
    all of a group of similar texts share, in sub-tiles of about TILE classes.
    """
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lead = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    lead = both.join(lead.select(F.col("a").alias("b"), "m"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("m").alias("lead"))
    sides = lead.groupBy("lead").agg(F.ceil(F.count("*") / TILE).alias("s"))
    tile = written(lead.join(sides, "lead").select("cls", F.xxhash64("lead", F.pmod(F.xxhash64("cls"), F.col("s"))).alias("tile")), "tiles")
    ta, tb = tile.select(F.col("cls").alias("a"), F.col("tile").alias("ta")), tile.select(F.col("cls").alias("b"), F.col("tile").alias("tb"))
    placed = pairs.join(ta, "a").join(tb, "b").select(F.xxhash64(F.least("ta", "tb"), F.greatest("ta", "tb")).alias("tile"), "a", "b")
    placed = written(placed, "placed")
    return placed, placed.select("tile", F.explode(F.array("a", "b")).alias("cls")).distinct()


def _judged(placed: DataFrame, payload: DataFrame, judge, targets: int) -> DataFrame:
    """The pairs that ``judge`` finds similar, given what each tile needs of its classes."""
    sent = payload.select("tile", F.col("cls").alias("a"), F.lit(None).cast("long").alias("b"), "payload")
    rows = sent.union(placed.select("tile", "a", "b", F.lit(None).cast("binary"))).repartition(targets, "tile").sortWithinPartitions("tile")

    def verify(batches):
        for _, own in _by_tile(batches):
            sets = {a: raw for _, a, _, raw in own if raw is not None}
            a, b = np.array([(a, b) for _, a, b, raw in own if raw is None]).T
            good = judge(sets, a, b)
            if good.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    return rows.mapInArrow(releasing(verify), "a long, b long")


def _by_tile(batches):
    """(tile, its rows) of rows sorted by their first column; one tile in memory at a time."""
    tile, own = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != tile:
                if own:
                    yield tile, own
                tile, own = row[0], []
            own.append(row)
    if own:
        yield tile, own


def _near(x: np.ndarray, y: np.ndarray, t: Fraction) -> np.ndarray:
    """Whether sketches (size, then parities) may be of similar sets; rows against rows."""
    apart = np.bitwise_count(x[..., 1:] ^ y[..., 1:]).sum(-1, dtype=np.int64)
    a, b = x[..., 0].astype(np.int64), y[..., 0].astype(np.int64)
    return ((t.denominator + t.numerator) * apart <= (t.denominator - t.numerator) * (a + b)) & (t.denominator * np.minimum(a, b) >= t.numerator * np.maximum(a, b))


def _tail(records: np.ndarray, kind: np.ndarray) -> bytes:
    out = np.zeros(len(records), np.dtype([("record", _CLASS), ("kind", "u1")]))
    out["record"], out["kind"] = records, kind
    return out.tobytes()


def _tiled(large: DataFrame, sketch: DataFrame, targets: int, t: Fraction) -> DataFrame:
    """(a, b) of the wanted pairs of large buckets whose wide sketches may be of similar sets, tile by tile."""
    width = len(_tail(np.zeros(1, _CLASS), np.zeros(1, np.uint8)))

    def members(batches):
        for batch in batches:
            for name, parts, k, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n", "members"))):
                own = [raw[i : i + width] for i in range(0, len(raw), width)]
                cls = np.frombuffer(raw, np.dtype([("record", _CLASS), ("kind", "u1")]))["record"]["cls"].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own)), pa.array([parts] * len(own)), pa.array([k] * len(own), pa.int64()), pa.array(cls), pa.array(own, pa.binary())], ["bucket", "parts", "k", "cls", "record"])

    rows = large.select("a", "b", "n", "members").mapInArrow(releasing(members), "bucket long, parts long, k long, cls long, record binary").join(sketch, "cls")
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(F.xxhash64("bucket", F.least("k", "o"), F.greatest("k", "o")).alias("tile"), "k", "record", "s").repartition(targets, "tile").sortWithinPartitions("tile")

    def compare(batches):
        for _, own in _by_tile(batches):
            side = np.array([k for _, k, _, _ in own])
            record = np.frombuffer(b"".join(r for _, _, r, _ in own), np.dtype([("record", _CLASS), ("kind", "u1")]))
            sketches = [s for *_, s in own]
            wide = np.stack([_folded(np.frombuffer(s, "<u8"), SKETCH_BITS // 64) for s in sketches])
            one = np.flatnonzero(side == side.min())
            other = np.flatnonzero(side == side.max())
            cls, kind = record["record"]["cls"], record["kind"]
            for i in one.tolist():  # a row of the tile at a time
                j = other[cls[other] > cls[i]] if side.min() == side.max() else other
                j = j[_near(wide[i], wide[j], t)]
                same = np.full(len(j), i)
                j = j[_wanted(record["record"][same], record["record"][j], kind[same], kind[j], t)]
                j = j[_alike([sketches[i]] * len(j), [sketches[k] for k in j.tolist()], t)]
                if len(j):
                    a, b = cls[i : i + 1].repeat(len(j)), cls[j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b).view(np.int64)), pa.array(np.maximum(a, b).view(np.int64))], ["a", "b"])

    return rows.mapInArrow(releasing(compare), "a long, b long")


def _nameless(df: DataFrame, id: str, text: str, chosen: DataFrame, n: int, bands: Bands) -> DataFrame:
    """Texts of classes whose documents have no id at all."""
    if not chosen.where("rep is null").head(1):
        return df.sparkSession.createDataFrame([], "cls long, text string, tiles array<long>")

    def classed(batches):
        for batch in batches:
            cls = np.zeros(batch.num_rows, np.int64)
            for first, row, element in shingles(batch.column(0), n):
                rows = int(row[-1]) + 1 if len(row) else 0
                cls[first : first + rows] = sketches(row, element, rows, bands)[0].view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls)], ["text", "cls"])

    rows = df.where(F.col(id).isNull()).select(text).mapInArrow(releasing(classed), "text string, cls long")
    return rows.join(chosen.where("rep is null").select("cls", "tiles"), "cls").select("cls", "text", "tiles")


def classed(df: DataFrame, text: str = "text", n: int = 5, t: Fraction = Fraction(4, 5)) -> DataFrame:
    """Adds _cls, the class that ``join`` gives each text, or null where there is no word."""
    bands = Bands(t)

    def classes(texts: pa.Array) -> list[pa.Array]:
        cls = np.zeros(len(texts), np.int64)
        for first, row, element in shingles(texts, n):
            rows = int(row[-1]) + 1 if len(row) else 0
            cls[first : first + rows] = sketches(row, element, rows, bands)[0].view(np.int64)
        return [pa.array(cls, mask=cls == 0)]

    return appended(df, classes, text, "_cls long")


def _slices(row: np.ndarray):
    at = X.runs(row)
    return zip(row[at].tolist(), at.tolist(), np.append(at[1:], len(row)).tolist())


def similar(df: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, t: Fraction = Fraction(4, 5)) -> DataFrame:
    """(doc_id, n_shingles, n_similar, component_id), a row per document."""
    made = join(df, id, text, n, t)
    documents, classes, links = made["documents"], made["classes"], made["links"]
    other = classes.select(F.col("cls").alias("b"), "copies")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(other, "b").groupBy(F.col("a").alias("cls")).agg(F.sum("copies").alias("linked"))
    root = components(links).select(F.col("node").alias("cls"), "root")
    rooted = classes.join(root, "cls", "left").join(linked, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = rooted.join(named, "root").select("cls", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_similar"), "component_id")
    out = documents.join(of_class, "cls", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("component_id", "doc_id").alias("component_id"))
