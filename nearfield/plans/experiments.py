"""Analytics over experiment records: the series behind the published plots, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.sources.metrics import FIELDS

# The published records, in the order of metrics.FIELDS without the data set's name.
PUBLISHED = """
3,0,32,1024,64,0,0,0,0,10220,9120,0.521442,1.02919
3,0,36,1024,64,0,0,0,0,11750,12350,0.553717,1.0252
3,0,40,1024,64,0,0,0,0,13020,12930,0.583063,1.02191
3,0,44,1024,64,0,0,0,0,14110,16830,0.608451,1.01931
3,0,48,1024,64,0,0,0,0,15620,16580,0.630703,1.0172
3,0,52,1024,64,0,0,0,0,16990,22670,0.650297,1.01547
3,0,56,1024,64,0,0,0,0,18320,20830,0.668391,1.01397
3,0,60,1024,64,0,0,0,0,19630,28370,0.683639,1.01278
3,0,64,1024,64,0,0,0,0,20530,21980,0.698412,1.01169
5,0,32,1024,64,0,0,0,390,5560,9530,0.496976,1.01443
5,0,36,1024,64,0,0,0,410,6270,13060,0.526458,1.01268
5,0,40,1024,64,0,0,0,400,6960,14570,0.557758,1.01099
5,0,44,1024,64,0,0,0,410,7640,17920,0.580468,1.00986
5,0,48,1024,64,0,0,0,420,8330,18430,0.5997,1.00897
5,0,52,1024,64,0,0,0,410,8990,24360,0.621762,1.00801
5,0,56,1024,64,0,0,0,400,9680,24200,0.635418,1.00745
5,0,60,1024,64,0,0,0,390,10370,30160,0.650564,1.00686
5,0,64,1024,64,0,0,0,400,11060,24700,0.668061,1.00622
""".split()

#: Bits of a sketch unit by method, and of a key unit by key method; a method without one has no such axis.
SKETCH_AXIS = {3: 32, 4: 8, 5: 32}
SKETCH_SCALE = {3: 32, 5: 32, 2: 1}
KEY_SCALE = {4: 8, 3: 16, 5: 16, 7: 16}


def published(spark: SparkSession) -> DataFrame:
    names = [f.split()[0] for f in FIELDS.split(", ")]
    rows = [tuple(int(x) if i < 11 else float(x) for i, x in enumerate(line.split(","))) + (None,) for line in PUBLISHED]
    assert len(names) == len(rows[0])
    return spark.createDataFrame(rows, FIELDS)


def _scaled(records: DataFrame, by: str, column: str, scale: dict[int, int], out: str) -> DataFrame:
    """Keeps the methods of ``scale`` and multiplies ``column``."""
    factor = F.lit(None).cast("int")
    for code, s in scale.items():
        factor = F.when(F.col(by) == code, s).otherwise(factor)
    return records.where(F.col(by).isin(*scale)).withColumn(out, F.col(column) * factor)


def with_qps(records: DataFrame, n_queries: int) -> DataFrame:
    """Adds queries per second; scan times are milliseconds."""
    return records.withColumn("qps", F.try_divide(F.lit(float(n_queries)), F.col("scanTime") / 1000))


def key_bits(records: DataFrame) -> DataFrame:
    return _scaled(records, "keyImplementation", "bucketKeyBits", KEY_SCALE, "bucketKeyBits")


def sketch_bits(records: DataFrame) -> DataFrame:
    return _scaled(records, "implementation", "sketchDim", SKETCH_SCALE, "sketchDim")


def without_outliers(records: DataFrame, most_ms: int = 20_000) -> DataFrame:
    return records.where(F.col("scanTime") < most_ms)


def _queues(k: int) -> list[int]:
    return [64, 128] if k == 1024 else [8, 32, 128]


def buffer_vs_sort(records: DataFrame, n_queries: int, k: int) -> DataFrame:
    """(mode, THREAD_QUEUE_SIZE, qps) of the exact scan."""
    rows = with_qps(records, n_queries).where((F.col("implementation") == 2) & (F.col("k") == k))
    return rows.select(F.when(F.col("WITH_TQ_OR_BUFFER") == 0, "buffer").otherwise("sort").alias("mode"), "THREAD_QUEUE_SIZE", "qps")


def recall_vs_time(records: DataFrame, n_queries: int, k: int) -> DataFrame:
    """(implementation, THREAD_QUEUE_SIZE, recall, qps) of the sketch scans."""
    rows = with_qps(records, n_queries).where(F.col("implementation").isin(3, 4, 5) & (F.col("k") == k) & F.col("THREAD_QUEUE_SIZE").isin(*_queues(k)))
    return rows.select("implementation", "THREAD_QUEUE_SIZE", "recall", "qps")


def recall_vs_bits(records: DataFrame, k: int) -> DataFrame:
    """(implementation, THREAD_QUEUE_SIZE, bits, recall)"""
    rows = _scaled(records, "implementation", "sketchDim", SKETCH_AXIS, "bits").where((F.col("k") == k) & F.col("THREAD_QUEUE_SIZE").isin(*_queues(k)))
    return rows.select("implementation", "THREAD_QUEUE_SIZE", "bits", "recall")


def ratio_vs_time(records: DataFrame, n_queries: int, k: int) -> DataFrame:
    """(implementation, THREAD_QUEUE_SIZE, avgDistance, qps) of buffered sketch scans below 33 x 32 bits."""
    rows = with_qps(records, n_queries).where((F.col("WITH_TQ_OR_BUFFER") == 0) & (F.col("sketchDim") < 32 * 33) & F.col("implementation").isin(3, 4, 5))
    rows = rows.where((F.col("k") == k) & F.col("THREAD_QUEUE_SIZE").isin(*_queues(k)))
    return rows.select("implementation", "THREAD_QUEUE_SIZE", "avgDistance", "qps")


def lsh_series(records: DataFrame, implementation: int, key: int, x: str, y: str, tables: int | None = None) -> DataFrame:
    """(x, y) of one pair of methods, for one number of tables or all."""
    rows = records.where((F.col("implementation") == implementation) & (F.col("keyImplementation") == key))
    return (rows if tables is None else rows.where(F.col("tables") == tables)).select(x, y)


def facets(records: DataFrame, by: tuple[str, ...] = ("k", "THREAD_QUEUE_SIZE", "tables")) -> DataFrame:
    """The values of the fields ``by`` that occur together, each with the number of its records: one plot each."""
    return records.groupBy(*by).agg(F.count("*").alias("n"))


def of_facet(records: DataFrame, **values: int) -> DataFrame:
    """The records of one plot, by field and value."""
    for field, value in values.items():
        records = records.where(F.col(field) == value)
    return records


def lsh_recall_vs_time(records: DataFrame, n_queries: int, k: int, queue: int = 128) -> DataFrame:
    """(implementation, keyImplementation, tables, recall, qps)"""
    rows = with_qps(records, n_queries).where((F.col("k") == k) & (F.col("THREAD_QUEUE_SIZE") == queue) & (F.col("keyImplementation") > 0))
    return rows.select("implementation", "keyImplementation", "tables", "recall", "qps")


def lsh_bits_vs_recall(records: DataFrame, k: int, queue: int = 128, sketch: int = 512) -> DataFrame:
    """(implementation, keyImplementation, tables, bucketKeyBits, recall): sketches of one size, or none."""
    rows = records.where((F.col("k") == k) & (F.col("THREAD_QUEUE_SIZE") == queue) & ((F.col("sketchDim") == sketch) | (F.col("implementation") == 2)) & (F.col("keyImplementation") > 0))
    return rows.select("implementation", "keyImplementation", "tables", "bucketKeyBits", "recall")


def report(records: DataFrame, lsh: DataFrame, n_queries: int, k: int, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The six series by name; all of them by default."""
    series: dict[str, Callable[[], DataFrame]] = {
        "buffer_vs_sort": lambda: buffer_vs_sort(records, n_queries, k),
        "recall_vs_time": lambda: recall_vs_time(records, n_queries, k),
        "recall_vs_bits": lambda: recall_vs_bits(records, k),
        "ratio_vs_time": lambda: ratio_vs_time(records, n_queries, k),
        "lsh_recall_vs_time": lambda: lsh_recall_vs_time(lsh, n_queries, k),
        "lsh_bits_vs_recall": lambda: lsh_bits_vs_recall(lsh, k),
    }
    unknown = set(names or ()) - set(series)
    if unknown:
        raise ValueError(f"unknown series: {sorted(unknown)}")
    return {n: f() for n, f in series.items() if not names or n in names}
