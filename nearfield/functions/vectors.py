"""Vector arithmetic as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda t, x: t + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x))


def unit(v: Column) -> Column:
    """v over its length; the components of a zero vector become null."""
    # As an array, so that the length is worked out once a row; a lambda would do it again for each component.
    return F.zip_with(v, F.array_repeat(norm(v), F.size(v)), F.try_divide)


def shifted(v: Column, by: Sequence[float]) -> Column:
    return F.zip_with(v, literal(by), lambda x, m: x + m)


def padded(v: Column, size: int) -> Column:
    return F.concat(v, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(v)))
