"""The canonical vector text file, and word-vector text.

Canonical: line 1 the number of rows, line 2 of components, then ``id v1 .. vd``.
Word vectors: ``token v1 .. vd`` a line, no header.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _numbers(tokens, first: int):
    return F.transform(F.slice(tokens, first, F.greatest(F.size(tokens) - first + 1, F.lit(0))), lambda x: x.cast("double"))


def _tokens():
    return F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, v) of a canonical file; ids are those of the file."""
    rows = spark.read.text(path).select(_tokens().alias("t")).where(F.size("t") > 1)
    return rows.select(F.element_at("t", 1).cast("long").alias("id"), _numbers(F.col("t"), 2).alias("v"))


def read_shape(spark: SparkSession, path: str) -> tuple[int, int]:
    """(rows, components) as the header states them."""
    head = [int(r["value"]) for r in spark.read.text(path).limit(2).collect()]
    return head[0], head[1]


def read_word_vectors(spark: SparkSession, path: str, n: int, dim: int) -> DataFrame:
    """(id, v) of the first n lines of word-vector text: ids from 0 in file order, tokens dropped."""
    lines = spark.read.text(path, wholetext=False).withColumn("place", F.monotonically_increasing_id())
    rows = lines.orderBy("place").limit(n).select("place", _tokens().alias("t"))
    rows = rows.select("place", F.slice(_numbers(F.col("t"), 2), 1, dim).alias("v"))
    return rows.select((F.row_number().over(Window.orderBy("place")) - 1).cast("long").alias("id"), "v")


def write_vectors(vectors: DataFrame, path: str) -> None:
    """One canonical file, ids renumbered from 0 in id order; an interchange format for small sets (Parquet is the native one)."""
    from nearfield.operators.split import dense_ids

    shape = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
    line = F.concat(F.col("id").cast("string"), F.lit(" "), F.array_join(F.transform("v", lambda x: x.cast("string")), " "), F.lit(" "))
    rows = dense_ids(vectors).select(F.col("id").alias("place"), line.alias("value"))
    head = vectors.sparkSession.createDataFrame([(-2, str(shape["n"])), (-1, str(shape["d"]))], "place long, value string")
    head.unionByName(rows).coalesce(1).sortWithinPartitions("place").select("value").write.text(path)
