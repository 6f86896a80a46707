"""Vector expressions over arrays, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    prod = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """v over its length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero; null where either is null."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def l2_distance2(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors where mask is 1: sum(v * mask) / max(sum(mask), 1e-9)."""
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, x: s + x.cast("double")), F.lit(1e-9))
    rows = F.zip_with(tokens, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m.cast("double")))
    zero = F.transform(F.element_at(tokens, 1), lambda x: F.lit(0.0))
    return F.transform(F.aggregate(rows, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b)), lambda x: x / n)
