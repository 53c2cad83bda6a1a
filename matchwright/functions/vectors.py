"""Vector expressions on ``ARRAY<DOUBLE>`` columns, for pairs that already meet.

Finding the pairs is the job of ``operators.nearest``; these functions score a pair
that an equi-join has brought together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8  # fixed value: added to the norm before dividing
INFINITE = float("inf")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(_total(F.transform(v, lambda x: x * x)))


def unit(v: Column) -> Column:
    """``v / (|v| + 1e-8)``; a zero vector stays zero."""
    return _let(norm(v) + F.lit(EPSILON), lambda n: F.transform(v, lambda x: x / n))


def fit(v: Column, n: int) -> Column:
    """Pad with zeros or cut to length ``n``; NULL becomes a zero vector."""
    filled = F.coalesce(v.cast("array<double>"), F.array().cast("array<double>"))
    return F.slice(F.concat(filled, F.array_repeat(F.lit(0.0), n)), 1, n)


def _guarded(a: Column, b: Column, value: Column) -> Column:
    same = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(same, value).otherwise(F.lit(INFINITE))


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def unit_euclidean(a: Column, b: Column) -> Column:
    """Distance of two vectors already brought to unit length."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return _guarded(a, b, F.sqrt(_total(squares)))


def euclidean(a: Column, b: Column) -> Column:
    return unit_euclidean(unit(a), unit(b))


def cosine(a: Column, b: Column) -> Column:
    """``1 - cos``; a zero vector is infinitely far from everything."""

    def of_units(p: Column) -> Column:
        size = norm(p["a"]) * norm(p["b"])
        near = F.lit(1.0) - dot(p["a"], p["b"]) / F.nullif(size, F.lit(0.0))
        return F.coalesce(near, F.lit(INFINITE))

    pair = F.struct(unit(a).alias("a"), unit(b).alias("b"))
    return _guarded(a, b, _let(pair, of_units))


def manhattan(a: Column, b: Column) -> Column:
    gaps = F.zip_with(unit(a), unit(b), lambda x, y: F.abs(x - y))
    return _guarded(a, b, _total(gaps))


def weighted_euclidean(a: Column, b: Column, weights: Sequence[float] | None = None) -> Column:
    """Euclidean distance with one weight per component; wrong count is infinite."""
    squares = F.zip_with(unit(a), unit(b), lambda x, y: (x - y) * (x - y))
    if weights is None:
        return _guarded(a, b, F.sqrt(_total(squares)))
    w = F.array(*[F.lit(float(x)) for x in weights])
    weighted = F.zip_with(squares, w, lambda s, k: s * k)
    fits = F.size(a) == F.lit(len(weights))
    return F.when(fits, _guarded(a, b, F.sqrt(_total(weighted)))).otherwise(F.lit(INFINITE))


DISTANCES = {"euclidean": euclidean, "cosine": cosine, "manhattan": manhattan}


def distance(a: Column, b: Column, method: str = "euclidean") -> Column:
    if method not in DISTANCES:
        raise ValueError(f"unknown distance method: {method}")
    return DISTANCES[method](a, b)


def gaussian_similarity(d: Column, sigma: float = 1.0) -> Column:
    """``exp(-d^2 / 2s^2)`` with ``s = max(sigma, d/10)``; infinite or NaN gives 0."""
    width = F.greatest(F.lit(float(sigma)), d * 0.1)
    curve = F.exp(-(d * d) / (F.lit(2.0) * width * width))
    lost = d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(INFINITE))
    return F.when(lost, F.lit(0.0)).otherwise(F.least(F.greatest(curve, F.lit(0.0)), F.lit(1.0)))


def vector_similarity(a: Column, b: Column, sigma: float = 1.0) -> Column:
    """Gaussian similarity of two raw vectors; 0 when their lengths differ."""
    return gaussian_similarity(euclidean(a, b), sigma)
