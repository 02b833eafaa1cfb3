"""Quality rules (operator 10): document statistics and gradient-boosted trees.

Trees are grown here on histograms of the statistics with the logistic loss.
A feature may be held monotonic: a split whose children would rank the wrong
way is refused and the children's bounds are passed down, so the score never
rises with, say, the share of repeated lines.  A fitted model is five flat numpy
arrays; scoring walks all rows of a batch down all trees at once.

Fitting uses a bounded sample of labelled rows (``FIT_ROWS``, the smallest hashes
of the ids); everything else covers all rows and whole texts.

Cases: null text has no words (and fails the base rule); null labels, and labels
of ids that are not in the documents, are not used; with no usable label, or one
class only, the model keeps all that passes the base rule; repeated rows each
get the same verdict; columns with the names of the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

FIT_ROWS = 8_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that the trees see, and the direction in which each may move the score (0: free).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1,
    "upper": -1, "exclamations": -1, "digits": 0, "marks": 0, "line_words": 0, "distinct": 0,
}


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features), a row per text."""
    counts = np.zeros((len(texts), len(COUNTS)), np.int64)
    features = np.zeros((len(texts), len(FEATURES)))
    for first, data, borders in W.chunks(texts):
        n = len(borders) - 1
        doc, start, length, h = W.words(data, borders)
        per_doc = lambda at, weights=None: np.bincount(at, weights, n)
        n_words = per_doc(doc)

        def of_bytes(mask):
            total = np.concatenate([[0], np.cumsum(mask)])
            return total[borders[1:]] - total[borders[:-1]]

        lead = (data & 0xC0) != 0x80
        word_chars = of_bytes(lead & ~W.BLANK[data])
        n_symbols = of_bytes(SYMBOLS[data])

        line_doc, line_start, line_length = W.lines(data, borders)
        solid = np.concatenate([[0], np.cumsum(~W.BLANK[data])])
        full = solid[line_start + line_length] > solid[line_start]
        line_doc, line_start, line_length = line_doc[full], line_start[full], line_length[full]
        key = W.mix(W.segment_hash(data, line_start, line_length, W.BYTE_HASH) + line_doc.astype(np.uint64) * W.STEPS[7])
        _, firsts = np.unique(key, return_index=True)
        n_lines = per_doc(line_doc)
        n_dup = n_lines - per_doc(line_doc[firsts])

        at, g = W.grams(h, doc, 3)
        g = W.mix(g + doc[at].astype(np.uint64) * W.STEPS[7])
        ordered = np.sort(g)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        repeated = np.zeros(len(h) + 3, bool)
        if len(twice):
            k = np.minimum(np.searchsorted(twice, g), len(twice) - 1)
            hit = at[twice[k] == g]
            for step in range(3):
                repeated[hit + step] = True
        n_repeat = per_doc(doc, repeated[: len(h)]).astype(np.int64)
        _, firsts = np.unique(W.mix(h + doc.astype(np.uint64) * W.STEPS[7]), return_index=True)
        distinct = per_doc(doc[firsts])

        rows = slice(first, first + n)
        counts[rows] = np.stack([n_words, word_chars, n_symbols, n_dup, n_repeat], 1)
        chars, some_words, some_lines = np.maximum(word_chars, 1), np.maximum(n_words, 1), np.maximum(n_lines, 1)
        upper = of_bytes((data >= 65) & (data <= 90))
        letters = upper + of_bytes((data >= 97) & (data <= 122))
        marks = of_bytes((data == 44) | (data == 46))
        features[rows] = np.stack([
            np.log1p(n_words), word_chars / some_words, n_symbols / chars, n_dup / some_lines, n_repeat / some_words,
            upper / np.maximum(letters, 1), of_bytes(data == 33) / chars, of_bytes((data >= 48) & (data <= 57)) / chars,
            marks / chars, np.log1p(n_words / some_lines), distinct / some_words,
        ], 1)
    return counts, features


@dataclass
class Trees:
    """Flattened trees: node arrays with absolute child numbers; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots) or not len(x):
            return np.full(len(x), self.bias)
        node = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.bias + self.value[node].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, l2: float = 2.0, least: float = 5.0) -> Trees:
    """Gradient-boosted trees on the logistic loss; deterministic."""
    if not len(y) or y.min() == y.max():
        return Trees(*(np.zeros(0, np.int64),) * 4, np.zeros(0), np.zeros(0, np.int64), 0, 4.0 if not len(y) or y.max() else -4.0)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    share = y.mean()
    bias = float(np.log(share / (1 - share)))
    raw = np.full(len(y), bias)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []

    def grow(rows, g, h, level, low, high) -> int:
        k = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = float(np.clip(gs / (hs + l2), low, high))
        nodes.append([0, np.inf, k, k, leaf * rate])
        if level == depth or len(rows) < 2 * least:
            return k
        best = (1e-3, None)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[rows, f]
            gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
            vl, vr = np.clip(gl / (hl + l2), low, high), np.clip((gs - gl) / (hs - hl + l2), low, high)
            gain = gl * vl - (hl + l2) * vl**2 / 2 + (gs - gl) * vr - (hs - hl + l2) * vr**2 / 2 - (gs * leaf - (hs + l2) * leaf**2 / 2)
            bad = (nl < least) | (len(rows) - nl < least) | (directions[f] * (vr - vl) < 0)
            gain[bad] = -np.inf
            if gain.max() > best[0]:
                c = int(gain.argmax())
                best = (gain[c], (f, c, vl[c], vr[c]))
        if best[1] is None:
            return k
        f, c, vl, vr = best[1]
        mid = (vl + vr) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[directions[f]]
        goes = binned[rows, f] <= c
        nodes[k][:2] = [f, float(edges[f][c])]
        nodes[k][2] = grow(rows[goes], g, h, level + 1, *bounds[0])
        nodes[k][3] = grow(rows[~goes], g, h, level + 1, *bounds[1])
        return k

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        at = len(nodes)
        roots.append(grow(np.arange(len(y)), y - p, np.maximum(p * (1 - p), 1e-6), 0, -8.0, 8.0))
        f, t, le, ri, v = (np.array(c) for c in zip(*nodes[at:]))
        node = np.zeros(len(y), np.int64)
        for _ in range(depth):
            node = np.where(x[np.arange(len(y)), f[node]] <= t[node], le[node] - at, ri[node] - at)
        raw += v[node]
    f, t, le, ri, v = (np.array(c) for c in zip(*nodes))
    return Trees(f, t.astype(float), le, ri, v.astype(float), np.array(roots), depth, bias)


def train(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Trees:
    """A model of ``labels.quality`` from at most ``rows`` labelled documents (the least hashes of the ids)."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where("doc_id is not null and quality is not null")
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)  # bounded, so it may be broadcast
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")

    def run(batches):
        for batch in batches:
            _, x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *(pa.array(c) for c in x.T)], ["doc_id", "quality", *FEATURES])

    schema = "doc_id long, quality double, " + ", ".join(f"{f} double" for f in FEATURES)
    least = F.min(F.struct("quality", *FEATURES)).alias("r")  # one row per id, so at most `rows` reach the driver
    found = texts.mapInArrow(run, schema).groupBy("doc_id").agg(least).select("doc_id", "r.*").toPandas().sort_values("doc_id", ignore_index=True)
    return fit(found[list(FEATURES)].to_numpy(float), (found["quality"].to_numpy(float) > 0.5).astype(float), list(FEATURES.values()))


def judge(df: DataFrame, model: Trees, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """Adds the counts, ``base_failed``, ``quality_score`` and ``kept``."""

    @F.arrow_udf(", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, quality_score double")
    def judged(batch: pa.Array) -> pa.Array:
        counts, x = statistics(batch)
        n, repeats = counts[:, 0], counts[:, 4]
        failed = (n < 50) | (100 * repeats > 50 * n)
        return pa.StructArray.from_arrays([*(pa.array(c) for c in counts.T), pa.array(failed), pa.array(model.score(x))], [*COUNTS, "base_failed", "quality_score"])

    out = df.withColumn("_q", judged(text))
    for c in (*COUNTS, "base_failed", "quality_score"):
        out = out.withColumn(c, F.col(f"_q.{c}"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_score") >= threshold)).drop("_q")
