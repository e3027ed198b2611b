"""Curves of the theory of the hash families."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rho(spark: SparkSession, steps: int = 40, step: float = 0.05) -> DataFrame:
    """(c, rho): the exponent 1 / (2 c^2 - 1) for c from 1 on."""
    c = F.round(1 + F.col("id") * F.lit(step), 6)
    return spark.range(steps + 1).select(c.alias("c"), (1 / (2 * c * c - 1)).alias("rho"))


def same_bit(degrees: float) -> float:
    """Chance that a SimHash bit agrees for two vectors at an angle."""
    return 1 - math.radians(degrees) / math.pi


def differing_bits(spark: SparkSession, bits: int, degrees: float, factor: float) -> DataFrame:
    """(n, close, far): chance of n differing bits at an angle, and at ``factor`` times it."""
    i = F.col("id")
    logs = [math.lgamma(bits + 1) - math.lgamma(k + 1) - math.lgamma(bits - k + 1) for k in range(bits + 1)]
    choose = F.element_at(F.array(*map(F.lit, logs)), (i + 1).cast("int"))

    def pmf(p: float):
        if p in (0.0, 1.0):
            return F.when(i == (bits if p else 0), 1.0).otherwise(0.0)
        return F.exp(choose + i * math.log(p) + (bits - i) * math.log1p(-p))

    return spark.range(bits + 1).select(i.alias("n"), pmf(1 - same_bit(degrees)).alias("close"), pmf(1 - same_bit(degrees * factor)).alias("far"))
