"""Vector expressions. Stored vectors are array<float>; arithmetic is done in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    return _total(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(_total(F.transform(as_double(v), lambda x: x * x)))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays zero.

    The length is bound as a lambda variable, so it is computed once per row, not per element.
    """
    scaled = F.transform(
        F.array(norm(v)),
        lambda n: F.transform(as_double(v), lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))),
    )
    return F.get(scaled, F.lit(0))


def weighted_sum(a: Column, wa: float, b: Column, wb: float) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: F.lit(wa) * x + F.lit(wb) * y)
