"""Vector columns: encodings (V2), cosine (V1), running mean (V7), all in the JVM and in double precision."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def cosine(a, b, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """V1: 0 where either norm is 0, null where the lengths differ (such a hit is skipped); a null element counts as NaN."""
    a, b = _col(a), _col(b)
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    whole = lambda v: F.transform(v, lambda x: F.coalesce(x.cast("double"), F.lit(float("nan"))))
    return F.when((na == 0) | (nb == 0), 0.0).when(F.size(a) == F.size(b), dot(whole(a), whole(b)) / (na * nb))


def likeness(a: Sequence[float], b: Sequence[float]) -> float:
    """V1 of two Python vectors, for folds; 0 where either norm is 0 or the lengths differ."""
    size = math.sqrt(math.fsum(x * x for x in a) * math.fsum(y * y for y in b))
    return math.fsum(x * y for x, y in zip(a, b)) / size if size and len(a) == len(b) else 0.0


def running_mean(a, b) -> Column:
    """V7: the mean of what has been packed and the next vector, so earlier weights halve at every step."""
    return F.zip_with(_col(a), _col(b), lambda x, y: (x + y) / 2)


def from_variant(c) -> Column:
    """V2: a vector out of any of its JSON encodings, null for anything else.  The nested pair goes first, since a plain cast would turn it into nulls."""
    v = _col(c)
    name = F.try_variant_get(v, "$[0][0]", "string")
    pair = F.try_variant_get(v, "$[0][1]", "array<float>")
    return F.coalesce(F.when(name == "values", pair), F.try_variant_get(v, "$.values", "array<float>"), F.when(name.isNull(), F.try_variant_get(v, "$", "array<float>")))


def has_embedding(c) -> Column:
    """A vector is there and not empty (the object encoding counts, unlike in the original: it can be searched)."""
    return F.coalesce(F.size(_col(c)) > 0, F.lit(False))
