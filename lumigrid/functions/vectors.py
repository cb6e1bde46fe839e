"""Vector arithmetic over array columns, in double precision, and the raised-cosine kernel."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """The cosine of two vectors; null if one is null or zero. Norms that are known already can be passed."""
    return dot(a, b) / F.nullif((norm_a if norm_a is not None else norm(a)) * (norm_b if norm_b is not None else norm(b)), F.lit(0.0))


def normalized(a: Column, epsilon: float = 1e-9) -> Column:
    n = norm(a) + epsilon
    return F.transform(a, lambda x: x.cast("double") / n)


def kernel(distance: Column) -> Column:
    """(1 + cos(pi d)) / 2 with d clamped to 0..1; a null distance counts as 0."""
    return (1.0 + F.cos(F.lit(math.pi) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), distance)))) / 2.0


def valid(a: Column) -> Column:
    """Not null, not empty and not all zero."""
    return F.coalesce(a.isNotNull() & (F.size(a) > 0) & F.exists(a, lambda x: x != 0), F.lit(False))


def rounded(x: Column, places: int = 6) -> Column:
    """Rounded, with -0.0 as 0.0."""
    return F.round(x, places) + F.lit(0.0)
