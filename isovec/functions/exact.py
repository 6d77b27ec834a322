"""Exact vector metrics, norm and normalisation as Catalyst expressions.

Vectors are arrays of float or double; components become double before any
arithmetic. A null vector or a null component gives null, unequal lengths raise
an error, and the length is looked at first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SAME_LENGTH = "The arguments must have the same length"
NO_MAGNITUDE = "Vector magnitude cannot be zero"
INFINITY = float("inf")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def total(values: Column, zero: float | int = 0.0) -> Column:
    return F.aggregate(values, F.lit(zero), lambda a, b: a + b)


def has_null(x: Column) -> Column:
    return F.exists(x, lambda v: v.isNull())


def fail(message: str | Column) -> Column:
    return F.raise_error(F.lit(message) if isinstance(message, str) else message)


def single(x: Column, value: Column) -> Column:
    return F.when(x.isNull() | has_null(x), None).otherwise(value)


def paired(x: Column, y: Column, value: Column, *checks: tuple[Column, Column]) -> Column:
    """``value`` behind the guards; ``checks`` are further conditions with their errors, after the length's."""
    guarded = F.when(x.isNull() | y.isNull(), None).when(F.size(x) != F.size(y), fail(SAME_LENGTH).cast("double"))
    for wrong, error in checks:
        guarded = guarded.when(wrong, error.cast("double"))
    return guarded.when(has_null(x) | has_null(y), None).otherwise(value)


def _squared(x: Column, y: Column) -> Column:
    return total(F.zip_with(doubles(x), doubles(y), lambda a, b: (a - b) * (a - b)))


def _dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(doubles(x), doubles(y), lambda a, b: a * b))


def _largest(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(doubles(x), F.abs)), F.lit(0.0))


def euclidean_squared_distance(x: Column, y: Column) -> Column:
    return paired(x, y, _squared(x, y))


def euclidean_distance(x: Column, y: Column) -> Column:
    return paired(x, y, F.sqrt(_squared(x, y)))


def manhattan_distance(x: Column, y: Column) -> Column:
    return paired(x, y, total(F.zip_with(doubles(x), doubles(y), lambda a, b: F.abs(a - b))))


def dot_product(x: Column, y: Column) -> Column:
    return paired(x, y, _dot(x, y))


def _scaled_cosine(x: Column, y: Column) -> Column:
    """For products beyond a double's range: both sides are divided by their largest component first."""

    def of(m: Column) -> Column:
        u = F.transform(doubles(x), lambda v: v / m["x"])
        v = F.transform(doubles(y), lambda w: w / m["y"])
        return (F.when((m["x"] == 0) | (m["y"] == 0), fail(NO_MAGNITUDE).cast("double"))
                .when(F.isnan(m["x"]) | F.isnan(m["y"]) | (m["x"] == INFINITY) | (m["y"] == INFINITY), F.lit(float("nan")))
                .otherwise(_dot(u, v) / (F.sqrt(_dot(u, u)) * F.sqrt(_dot(v, v)))))

    return bind(F.struct(_largest(x).alias("x"), _largest(y).alias("y")), of)


def plain_cosine(x: Column, y: Column, otherwise: Callable[[], Column]) -> Column:
    """The cosine where its products are finite and not zero. Dividing by the root of
    the product makes equal vectors exactly 1."""

    def of(s: Column) -> Column:
        product = s["x"] * s["y"]
        odd = (product == 0) | F.isnan(product) | (product == INFINITY) | (F.abs(s["d"]) == INFINITY)
        return F.when(odd, otherwise()).otherwise(s["d"] / F.sqrt(product))

    return bind(F.struct(_dot(x, y).alias("d"), _dot(x, x).alias("x"), _dot(y, y).alias("y")), of)


def cosine_similarity(x: Column, y: Column) -> Column:
    return paired(x, y, plain_cosine(x, y, lambda: _scaled_cosine(x, y)))


def cosine_distance(x: Column, y: Column) -> Column:
    return 1 - cosine_similarity(x, y)


def _norm(x: Column) -> Column:
    def scaled(m: Column) -> Column:
        return F.when((m == 0) | (m == INFINITY) | F.isnan(m), m).otherwise(
            m * F.sqrt(total(F.transform(doubles(x), lambda v: (v / m) * (v / m)))))

    return bind(_dot(x, x), lambda s: F.when((s == 0) | (s == INFINITY), bind(_largest(x), scaled)).otherwise(F.sqrt(s)))


def l2_norm(x: Column) -> Column:
    """The Euclidean norm, 0 for an empty vector."""
    return single(x, _norm(x))


def normalize_vector(x: Column, width: str = "double") -> Column:
    """The vector over its norm, as ``double`` or ``float``; an error where the norm is 0."""
    kind = f"array<{width}>"
    return single(x, bind(_norm(x), lambda n: F.when(n == 0, fail(NO_MAGNITUDE).cast(kind)).otherwise(
        F.transform(doubles(x), lambda v: v / n).cast(kind))))
