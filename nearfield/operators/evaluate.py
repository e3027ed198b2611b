"""Quality of a result against the truth, and statistics of hashes and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall(truth: DataFrame, result: DataFrame, k: int) -> DataFrame:
    """(recall): share of the first k true neighbours found, per query, averaged over the truth's queries."""
    true = truth.where(F.col("rank") <= k)
    hits = true.join(result.select("q_id", "d_id").distinct(), ["q_id", "d_id"], "left_semi").groupBy("q_id").agg(F.count("*").alias("n"))
    per_query = truth.select("q_id").distinct().join(hits, "q_id", "left").select((F.coalesce("n", F.lit(0)) / k).alias("r"))
    return per_query.agg(F.avg("r").alias("recall"))


def distance_ratio(truth: DataFrame, result: DataFrame, k: int) -> DataFrame:
    """(ratio): summed distance of the result over that of the first k true neighbours, averaged over queries."""
    true = truth.where(F.col("rank") <= k).groupBy("q_id").agg(F.sum("dist").alias("t"))
    found = result.groupBy("q_id").agg(F.sum("dist").alias("r"))
    return true.join(found, "q_id").agg(F.avg(F.try_divide("r", "t")).alias("ratio"))


def first_k(truth: DataFrame, k: int) -> DataFrame:
    """The first k of a truth table of any size and order, ranked anew by (dist, d_id)."""
    order = Window.partitionBy("q_id").orderBy("dist", "d_id")
    return truth.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall_of_large_truth(truth: DataFrame, result: DataFrame, k: int) -> DataFrame:
    """(recall): hits among the first k of a larger truth, over queries times k."""
    true = first_k(truth, k)
    queries = truth.agg(F.count_distinct("q_id").alias("nq"))
    hits = true.join(result.select("q_id", "d_id").distinct(), ["q_id", "d_id"], "left_semi").agg(F.count("*").alias("hits"))
    return hits.crossJoin(queries).select((F.col("hits") / (F.col("nq") * k)).alias("recall"))


def ratio_of_large_truth(truth: DataFrame, result: DataFrame, k: int) -> DataFrame:
    """(ratio): as ``distance_ratio``, against the first k of a larger truth."""
    return distance_ratio(first_k(truth, k), result, k)


def evaluate_large_truth(truth: DataFrame, result: DataFrame, k: int) -> DataFrame:
    """(recall, ratio) against a truth file of more than k neighbours a query, in any order; one row."""
    return recall_of_large_truth(truth, result, k).crossJoin(ratio_of_large_truth(truth, result, k))


def evaluate(truth: DataFrame, result: DataFrame, k: int) -> DataFrame:
    """(recall, ratio), one row."""
    return recall(truth, result, k).crossJoin(distance_ratio(truth, result, k))


def hash_histogram(hashed: DataFrame, column: str = "sketch") -> DataFrame:
    """(value, n) over all hash values of all rows."""
    return hashed.select(F.explode(column).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def key_histogram(hashed: DataFrame, column: str = "sketch") -> DataFrame:
    """(full_key, n): whole sketches as text of 8 bits a value."""
    text = F.array_join(F.transform(column, lambda x: F.lpad(F.bin(x), 8, "0")), "")
    return hashed.select(text.alias("full_key")).groupBy("full_key").agg(F.count("*").alias("n"))


def distance_histogram(distances: DataFrame, bins: int = 80) -> DataFrame:
    """(bin, n): equal widths over the range of ``dist``; the largest value falls in the last bin."""
    ends = distances.agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    wide = distances.crossJoin(F.broadcast(ends))  # one row
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("dist") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins))).otherwise(1)
    return wide.select(place.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
