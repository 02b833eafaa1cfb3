"""Similarity search (V11): score on the vectors alone, threshold, stable top-k, then the wide columns (late).

Scoring is a narrow projection over the corpus; the query vector is a literal, its
norm is folded at planning.  ``search`` for one query, ``nearest`` for a table of
queries, which is joined in blocks against all rows and reduced before it moves.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V


def checked(query: str, top_k: int = 5, threshold: float = 0.0, close_filter: str | None = "off", verify_top_n: int = 5) -> float:
    """The effective threshold, or ValueError."""
    least = X.CLOSE_FILTERS.get(str(close_filter or "").strip().lower())
    wrong = {
        "an empty query": not (query and query.strip()),
        f"top_k below one: {top_k}": top_k < 1,
        f"a threshold outside 0 to 1: {threshold}": math.isnan(threshold) or not 0 <= threshold <= 1,
        f"verify_top_n below one: {verify_top_n}": verify_top_n < 1,
        f"close_filter {close_filter!r}, not one of {', '.join(X.CLOSE_FILTERS)}": least is None,
    }
    if any(wrong.values()):
        raise ValueError("; ".join(what for what, so in wrong.items() if so))
    return max(threshold, least)


def scored(corpus: DataFrame, vector: Sequence[float], embedding: str = "embedding") -> DataFrame:
    """V1 on every row with a vector; rows whose vector has another length are skipped."""
    size = math.sqrt(sum(float(x) ** 2 for x in vector))
    rows = corpus.where(V.has_embedding(embedding))
    return rows.withColumn("similarity", V.cosine(embedding, V.literal(vector), norm_b=F.lit(size))).where("similarity is not null")


def above(df: DataFrame, threshold: float | Column, similarity: str = "similarity") -> DataFrame:
    """At or above the threshold; NaN is not."""
    return df.where(~F.isnan(similarity) & (F.col(similarity) >= threshold))


def search(corpus: DataFrame, vector: Sequence[float], top_k: int = 5, threshold: float = 0.0, order: Sequence[str] = ("source_file", "pos"), embedding: str = "embedding") -> DataFrame:
    """The best hits, ties in the order of the corpus (T1, T2), with closeness_label."""
    if top_k < 1:
        raise ValueError(f"top_k below one: {top_k}")
    hits = above(scored(corpus, vector, embedding), threshold)
    return hits.orderBy(F.desc("similarity"), *order).limit(top_k).withColumn("closeness_label", X.closeness("similarity"))


def ranked(hits: DataFrame, order: Sequence[str]) -> DataFrame:
    """1-based ranks of a bounded list of hits."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), *order)))


def nearest(corpus: DataFrame, queries: DataFrame, k: int = 1, id: str = "vec_id", embedding: str = "embedding", block: int = 1024, same: bool = False) -> DataFrame:
    """The k best rows for each query, exactly: (query_id, id, similarity), ties to the smaller id.

    Both sides are packed into blocks of raw vectors, so that what meets is a block of
    queries and a block of rows: a matrix product, of which k rows a query are kept.
    What is shuffled is that, not pairs.  ``same`` leaves out the row with the query's
    own id.
    """

    def packed(df: DataFrame, side: str) -> DataFrame:
        def pack(batches):
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
                rows = batch.column(1)
                flat, width = rows.flatten().to_numpy(zero_copy_only=False).astype("<f8"), rows.value_lengths().to_numpy(zero_copy_only=False)
                begins = np.cumsum(width) - width
                for w in np.unique(width).tolist():
                    own = np.flatnonzero(width == w)
                    for k in range(0, len(own), block):
                        some = own[k : k + block]
                        vectors = flat[begins[some][:, None] + np.arange(w)]
                        yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([ids[some].tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], [f"{side}_w", f"{side}_ids", f"{side}_v"])

        rows = df.where(V.has_embedding(embedding)).select(F.col(id).cast("long"), F.transform(embedding, lambda x: F.coalesce(x.cast("double"), F.lit(float("nan")))))
        return rows.mapInArrow(pack, f"{side}_w int, {side}_ids binary, {side}_v binary")

    def best(batches):
        for batch in batches:
            for w, q, a, v, i, b in zip(*(batch.column(c).to_pylist() for c in ("q_w", "q_ids", "q_v", "r_w", "r_ids", "r_v"))):
                if w != v:
                    continue  # vectors of another length are skipped
                qid, ids = np.frombuffer(q, "<i8"), np.frombuffer(i, "<i8")
                a, b = np.frombuffer(a, "<f8").reshape(-1, w), np.frombuffer(b, "<f8").reshape(-1, w)
                na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = (a @ b.T) / na[:, None] / nb[None, :]
                s[(na == 0)[:, None] | (nb == 0)[None, :]] = 0.0
                s[np.isnan(s)] = -np.inf
                if same:
                    s[qid[:, None] == ids[None, :]] = -np.inf
                top = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                score = np.take_along_axis(s, top, 1)
                use = ~np.isneginf(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, top.shape[1])[use.ravel()]), pa.array(ids[top][use]), pa.array(score[use])], ["query_id", "vec_id", "similarity"])

    met = packed(queries, "q").join(packed(corpus, "r"), F.lit(True))
    found = met.mapInArrow(best, "query_id long, vec_id long, similarity double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def response(hits: DataFrame, query: str, model: str, top_k: int, threshold: float, close_filter: str, source: str, fields: Sequence[str], verification: Column | None = None) -> DataFrame:
    """One row with the response's fields and its hits as an array, best first."""
    least = X.CLOSE_FILTERS[close_filter.strip().lower()]
    entry = F.struct("rank", *fields, F.col("similarity"), F.col("closeness_label"))
    return hits.agg(F.array_sort(F.collect_list(entry)).alias("results"), F.coalesce(F.max("similarity"), F.lit(0.0)).alias("top_similarity"), F.count("*").alias("result_count")).select(
        F.lit(query).alias("query"), F.lit(model).alias("model"), F.lit(top_k).alias("top_k"), F.lit(float(threshold)).alias("threshold"), F.lit(close_filter).alias("close_filter"),
        F.lit(least).alias("close_filter_threshold"), F.lit(max(threshold, least)).alias("effective_threshold"), "top_similarity",
        (verification if verification is not None else F.lit(None).cast("string")).alias("ai_verification"), F.lit(source).alias("embeddings_source"), "result_count", "results",
    )


def relevance(items: DataFrame, by: Sequence[str] = (), given: str | None = None) -> DataFrame:
    """checked_count, relevant_count and overall (the ratio's band, or the model's own word where it is one) of rows with is_relevant."""
    own = F.lower(X.strip(F.max(given))) if given else F.lit(None).cast("string")
    ratio = F.avg(F.coalesce(F.col("is_relevant"), F.lit(False)).cast("double"))
    band = F.when(ratio >= 0.75, "high").when(ratio <= 0.34, "low").otherwise("medium")
    agg = [F.count("*").alias("checked_count"), F.count_if("is_relevant").alias("relevant_count"), F.when(own.isin("high", "medium", "low"), own).otherwise(band).alias("overall")]
    return items.groupBy(*by).agg(*agg)


def judged(hits: DataFrame, items: DataFrame, top_n: int) -> DataFrame:
    """Hits (rank from 1) with ai_is_relevant, ai_relevance_score and ai_reason of the first top_n; of items with one index the last counts."""
    last = items.withColumn("_r", F.row_number().over(Window.partitionBy("index").orderBy(F.desc("pos")))).where("_r = 1 and index is not null")
    score = F.coalesce(F.col("score").try_cast("double"), F.lit(0.0))
    last = last.select((F.col("index") + 1).alias("rank"), F.coalesce("is_relevant", F.lit(False)).alias("_rel"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("_score"), F.substring(F.coalesce("reason", F.lit("")), 1, 200).alias("_reason"))
    asked = F.col("rank") <= max(1, top_n)
    out = hits.join(last, "rank", "left")
    out = out.withColumn("ai_is_relevant", F.when(asked, F.coalesce("_rel", F.lit(False)))).withColumn("ai_relevance_score", F.when(asked, F.coalesce("_score", F.lit(0.0))))
    return out.withColumn("ai_reason", F.when(asked, F.coalesce("_reason", F.lit("")))).drop("_rel", "_score", "_reason")
