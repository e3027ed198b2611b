"""Query hold-out: a deterministic draw without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_key(seed: int) -> Column:
    """A pseudo-random order of ids from whole-number arithmetic alone, the same in any engine."""
    return F.expr(f"pmod(pmod(id, 1000003) * 7919 + {seed} * 104729, 1000003) * 31 + pmod(id, 31)")


def hold_out(vectors: DataFrame, n_queries: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(data, queries): n_queries rows drawn as queries, the rest as data; ids are dense from 0 on both sides, in id order.

    The draw keeps the least keys by a top-n that moves n_queries ids a partition;
    ids are then renumbered by ``dense_ids``, which needs no single-partition sort.
    """
    chosen = vectors.select("id", draw_key(seed).alias("key")).orderBy("key", "id").limit(n_queries).select("id")
    queries = vectors.join(chosen, "id", "left_semi")
    data = vectors.join(chosen, "id", "left_anti")
    return dense_ids(data), dense_ids(queries)


def dense_ids(vectors: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Rows with ids renumbered 0..n-1 in id order: counts per id range, then places within each range."""
    ranged = vectors.withColumn("_range", F.floor(F.col("id") / width))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_range").orderBy("id")) - 1
    return ranged.join(starts, "_range").withColumn("id", (F.col("_start") + place).cast("long")).drop("_range", "_start")
