"""Row-wise preparation of vectors, as new DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions import vectors as V


def _components(*tables: DataFrame) -> DataFrame:
    rows = tables[0].select("v")
    for t in tables[1:]:
        rows = rows.unionByName(t.select("v"))
    return rows.select(F.posexplode("v").alias("pos", "x"))


def dim_mins(*tables: DataFrame) -> DataFrame:
    """(pos, m): the smaller of 0 and the least floor of each component over all tables."""
    return _components(*tables).groupBy("pos").agg(F.least(F.lit(0), F.min(F.floor("x"))).cast("long").alias("m"))


def dim_bounds(*tables: DataFrame) -> DataFrame:
    """(pos, bound): the larger of 0 and the greatest ceiling of each component."""
    return _components(*tables).groupBy("pos").agg(F.greatest(F.lit(0), F.max(F.ceil("x"))).cast("long").alias("bound"))


def index_map(bounds: DataFrame) -> DataFrame:
    """(pos, bound, first_slot): where each component's slots begin."""
    before = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return bounds.withColumn("first_slot", F.coalesce(F.sum("bound").over(before), F.lit(0)).cast("long"))


def _by_pos(table: DataFrame, column: str) -> list[int]:
    """One number a component; there are as many as a vector is long."""
    return [r[column] for r in table.orderBy("pos").collect()]


def non_negative(data: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables shifted so that no component is negative."""
    by = [abs(m) for m in _by_pos(dim_mins(data, queries), "m")]
    return tuple(t.withColumn("v", V.shifted(F.col("v"), by)) for t in (data, queries))


def unit_vectors(table: DataFrame) -> DataFrame:
    """Rows over their length; rows without a length go."""
    return table.where(V.norm(F.col("v")) > 0).withColumn("v", V.unit(F.col("v")))


def jaccard_ready(data: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shifted, then of unit length."""
    data, queries = non_negative(data, queries)
    return unit_vectors(data), unit_vectors(queries)


def minhash_ready(data: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """Both tables as ``jaccard_ready`` makes them, and the components' bounds."""
    data, queries = jaccard_ready(data, queries)
    return data, queries, _by_pos(dim_bounds(data, queries), "bound")
