"""Truth and result files: a header (queries, k), then ``query:`` and lines ``id distance``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(neighbours: DataFrame, row) -> DataFrame:
    """(q, r, value): the header, a label line a query, and a line a neighbour."""
    shape = neighbours.agg(F.count_distinct("q_id").alias("nq"), F.coalesce(F.max("rank"), F.lit(0)).alias("k")).first()
    head = neighbours.sparkSession.createDataFrame([(-2, 0, str(shape["nq"])), (-1, 0, str(shape["k"]))], "q long, r int, value string")
    labels = neighbours.select(F.col("q_id").alias("q")).distinct().select("q", F.lit(0).alias("r"), F.concat(F.col("q").cast("string"), F.lit(":")).alias("value"))
    rows = neighbours.select(F.col("q_id").alias("q"), F.col("rank").alias("r"), row.alias("value"))
    return head.unionByName(labels).unionByName(rows)


def write_neighbours(neighbours: DataFrame, path: str) -> None:
    """One text file; for results that one task can write (Parquet is the native sink)."""
    row = F.concat_ws(" ", F.col("d_id").cast("string"), F.col("dist").cast("string"))
    _lines(neighbours, row).coalesce(1).sortWithinPartitions("q", "r").select("value").write.text(path)


def formatted(neighbours: DataFrame) -> DataFrame:
    """(q, r, value): the lines of a result listing, distances with six decimals; order by q, r to print."""
    return _lines(neighbours, F.format_string("%d %f", "d_id", "dist"))


def ids_only(neighbours: DataFrame) -> DataFrame:
    """(q, r, value): the header, then only the ids."""
    return _lines(neighbours, F.col("d_id").cast("string")).where("q < 0 or r > 0")


def read_neighbours(spark: SparkSession, path: str) -> DataFrame:
    """(q_id, rank, d_id, dist) of such files, each read whole; rank follows the file."""
    text = spark.read.text(path, wholetext=True).select(F.split("value", "\n").alias("lines"), F.monotonically_increasing_id().alias("file"))
    rows = text.select("file", F.posexplode(F.slice("lines", 3, F.greatest(F.size("lines") - 2, F.lit(0)))).alias("at", "line")).where("trim(line) <> ''")
    label = F.when(F.col("line").rlike(r":\s*$"), F.regexp_extract("line", r"^\s*(\d+):", 1).cast("long"))
    order = Window.partitionBy("file").orderBy("at")
    rows = rows.withColumn("q_id", F.last(label, ignorenulls=True).over(order)).where(~F.col("line").rlike(r":\s*$"))
    parts = F.split(F.trim("line"), r"\s+")
    rows = rows.select("q_id", "at", parts.getItem(0).cast("long").alias("d_id"), parts.getItem(1).cast("double").alias("dist"))
    return rows.select("q_id", F.row_number().over(Window.partitionBy("q_id").orderBy("at")).alias("rank"), "d_id", "dist")


def first_reported(neighbours: DataFrame, report_k: int) -> DataFrame:
    """The first ``report_k`` of each query."""
    return neighbours.where(F.col("rank") <= report_k)


def read_distances(spark: SparkSession, path: str, share: float = 1.0, seed: int = 1, lines: int | None = None) -> DataFrame:
    """(dist) of a list with one distance a line and label lines that start with Q.

    lines: only so many lines from the start; share: draws a sample of the distances.
    """
    text = spark.read.text(path)
    if lines is not None:
        text = text.limit(lines)
    rows = text.where(~F.col("value").startswith("Q") & (F.trim("value") != "")).select(F.trim("value").cast("double").alias("dist"))
    return rows if share >= 1 else rows.sample(share, seed)
