"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import staged

#: Rows of one node that meet in one task of a join; the smallest neighbours of nodes with more are broadcast.
HOT = 4096
#: Hot nodes up to this number are broadcast (16 MB); more are left to the shuffle.
MOST_HOT = 500_000


def _hung(rows: DataFrame, low: DataFrame) -> DataFrame:
    """``rows(u, v)`` with the m of their u, from ``low(u, m, degree)``; rows of hot nodes are not gathered."""
    hot = low.where(F.col("degree") > HOT).select("u", "m")
    many = hot.count()
    if not 0 < many <= MOST_HOT:
        return rows.join(low.select("u", "m"), "u")
    found = rows.join(F.broadcast(hot), "u", "left")
    rest = found.where("m IS NULL").drop("m").join(low.where(F.col("degree") <= HOT).select("u", "m"), "u")
    return found.where("m IS NOT NULL").unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges(a, b)``; comp: the smallest node it reaches.

    Each round hangs the larger neighbours of a node, then the smaller ones, on
    its smallest neighbour; the stars that remain are the components.  The edges
    are never collected, and a round's result is a written table.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("degree"))
        large = _hung(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        hung = _hung(large, low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = staged(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        # A forest of stars: each node hangs once, and nothing hangs on a node that hangs itself.
        ends = small.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("hangs")), F.struct(F.col("v").alias("x"), F.lit(0).alias("hangs")))).alias("e")).select("e.*")
        state = ends.groupBy("x").agg(F.sum("hangs").alias("n"), F.min("hangs").alias("holds"))
        now = small
        if not state.where("n > 1 or (n = 1 and holds = 0)").limit(1).count():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
