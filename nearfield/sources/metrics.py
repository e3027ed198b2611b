"""Experiment records as CSV without a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIELDS = (
    "implementation INT, keyImplementation INT, sketchDim INT, k INT, THREAD_QUEUE_SIZE INT, bucketKeyBits INT, tables INT, "
    "WITH_TQ_OR_BUFFER INT, preprocessTime BIGINT, constructionTime BIGINT, scanTime BIGINT, recall DOUBLE, avgDistance DOUBLE, dataset STRING"
)


#: The orders in which records are listed.
BY_RECALL, BY_SKETCH, BY_QUEUE = ("recall", "scanTime"), ("sketchDim",), ("THREAD_QUEUE_SIZE",)


def in_order(records: DataFrame, by: tuple[str, ...] = BY_RECALL) -> DataFrame:
    """Records in the order of ``by``; ties by the other fields, so that every run lists them alike."""
    return records.orderBy(*by, *(c for c in records.columns if c not in by))


def read_metrics(spark: SparkSession, path: str, by: tuple[str, ...] = BY_RECALL) -> DataFrame:
    """Records in the order of ``by``; a missing 14th field reads as null."""
    return in_order(spark.read.schema(FIELDS).option("mode", "PERMISSIVE").csv(path), by)


def listed(records: DataFrame, by: tuple[str, ...] = BY_RECALL) -> DataFrame:
    """``records`` with their place in the order of ``by``, from 0."""
    rows = in_order(records, by).collect()  # a report of some dozen records
    return records.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"place INT, {FIELDS}")


def append_metrics(records: DataFrame, path: str) -> None:
    records.write.mode("append").csv(path)
