"""Line dedup over three-line windows (operator 1).

Every run of three consecutive lines that holds a word is hashed.  Of equal
windows anywhere in the corpus the first by (id, place) stays; the lines that any
later occurrence covers go, overlaps merged.  All windows are judged on the texts
as they came in.

Windows that repeat within an Arrow batch are settled there, so a passage that a
third of all rows share sends its key once a batch; its later occurrences there
are known already and go by document, not by key.  The rest meets by two independent
hashes of 64 bits; what comes back is one short row per document and target, joined
to the texts once.

Cases: a null text stays null (no lines); a text of fewer than three lines stays;
windows of blank lines only are no repeats; a null id comes before all others;
rows with the same id and text are one document and get the same result, rows
with the same id and another text are ordered by the hash of the text; result
columns (the text, n_lines, n_removed) replace others of their name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import words as W
from .tables import releasing, small_batches

_FIELDS = {"key": "<u8", "check": "<u8", "doc": "<i8", "tie": "<i8", "pos": "<i4"}
_EMPTY = np.uint64(0x5851F42D4C957F2D)


def windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first line, hash, second hash) of every window of three lines with a word."""
    rows, places, keys, checks = [], [], [], []
    for first, data, borders in W.chunks(texts):
        doc, start, length = W.lines(data, borders)
        full = length > 0
        made = []
        for lane in (0, 1):
            h = np.full(len(doc), _EMPTY)
            h[full] = W.segment_hash(data, start[full], length[full], W.BYTE_HASH, lane)
            at, g = W.grams(h, doc, 3)
            made.append(g)
        solid = np.concatenate([[0], np.cumsum(~W.BLANK[data])])
        has = solid[start + length] > solid[start]
        some = has[at] | has[at + 1] | has[at + 2] if len(at) else np.zeros(0, bool)
        at = at[some]
        rows.append(doc[at] + first)
        places.append(at - np.searchsorted(doc, doc[at]))
        keys.append(made[0][some])
        checks.append(made[1][some])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(places), np.concatenate(keys), np.concatenate(checks)


def _later(entry: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(entries that come first of their key, entries that come later), as indices; equal references are one occurrence."""
    order = np.lexsort((entry["pos"], entry["tie"], entry["doc"], entry["check"], entry["key"]))
    at = X.runs(entry["key"][order], entry["check"][order])
    leader = order[np.repeat(at, np.diff(at, append=len(order)))]
    same = np.ones(len(order), bool)
    for f in ("doc", "tie", "pos"):
        same &= entry[f][leader] == entry[f][order]
    return order[at], order[~same]


def home(doc: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """The key that a document's own entries meet by."""
    return W.mix(doc.view(np.uint64) * W.STEPS[0] + tie.view(np.uint64))


def _remove(text: str | None, places: list[bytes] | None) -> tuple[str | None, int, int]:
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    if not places:
        return text, len(lines), 0
    gone = np.zeros(len(lines) + 2, bool)
    at = np.frombuffer(b"".join(places), "<i4")
    for step in range(3):
        gone[at + step] = True
    kept = [line for line, out in zip(lines, gone) if not out]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def dedup_lines(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with repeated passages cut from the text, and n_lines, n_removed."""
    small_batches(df.sparkSession)
    n = X.targets(df.sparkSession, df)
    keyed = df.withColumn("_tie", F.xxhash64(F.col(text)))

    def spread(batches):
        for batch in batches:
            row, place, key, check = windows(batch.column(2))
            doc, tie = X.ids(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            entry = {"key": key, "check": check, "doc": doc[row], "tie": tie[row], "pos": place.astype("<i4")}
            first, later = _later(entry)
            yield from X.blobs(0, key[first], {f: v[first] for f, v in entry.items()}, n)
            nothing = np.zeros((len(later), 0), np.uint64)  # what is known to go needs no key
            yield from X.blobs(1, home(entry["doc"][later], entry["tie"][later]), {f: nothing if f in ("key", "check") else v[later] for f, v in entry.items()}, n)

    def settle(batches):
        found = X.gathered(batches, _FIELDS)
        parts = [found[1]] if 1 in found else []
        if 0 in found:
            own = _later(found[0])[1]
            parts.append({f: v[own] for f, v in found[0].items()})
        if not parts:
            return
        doc, tie, pos = (np.concatenate([p[f] for p in parts]) for f in ("doc", "tie", "pos"))
        order = np.lexsort((pos, tie, doc))
        doc, tie, pos = doc[order], tie[order], pos[order]
        at = X.runs(doc, tie)
        offsets = np.append(at, len(pos)).astype(np.int32) * 4
        places = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(pos.astype("<i4").tobytes())])
        if len(at):
            yield pa.RecordBatch.from_arrays([X.id_array(doc[at]), pa.array(tie[at]), places], ["_doc", "_tie2", "_places"])

    packed = keyed.select(F.col(id).cast("long"), "_tie", text).mapInArrow(releasing(spread), X.schema(_FIELDS))
    found = X.exchanged(packed, n).mapInArrow(releasing(settle), "_doc long, _tie2 long, _places binary")
    found = found.groupBy("_doc", "_tie2").agg(F.collect_list("_places").alias("_places"))

    @F.arrow_udf("text string, n_lines long, n_removed long")
    def removed(texts: pa.Array, places: pa.Array) -> pa.Array:
        rows = [_remove(t, p) for t, p in zip(texts.to_pylist(), places.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["text", "n_lines", "n_removed"])

    joined = keyed.join(found.hint("shuffle_hash"), keyed[id].cast("long").eqNullSafe(F.col("_doc")) & (F.col("_tie") == F.col("_tie2")), "left")
    out = joined.withColumn("_r", removed(text, "_places"))
    out = out.withColumn(text, F.col("_r.text")).withColumn("n_lines", F.col("_r.n_lines")).withColumn("n_removed", F.col("_r.n_removed"))
    return out.drop("_r", "_tie", "_tie2", "_doc", "_places")
