"""Nearest neighbours of a stream of queries, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from nearfield.operators.search import LshIndex, exact_knn


def stream_knn(queries: DataFrame, data: DataFrame, k: int, sink: Callable[[DataFrame, int], None], metric: str = "cosine", index: LshIndex | None = None, checkpoint: str | None = None):
    """Starts a streaming query that hands (neighbours, batch number) of each micro-batch to ``sink``.

    queries: a streaming DataFrame (id, v).  With an index, only its buckets are searched.
    The sink sees a batch again after a failure, so it should write by batch number.
    """

    def handle(batch: DataFrame, number: int) -> None:
        asked = batch.select("id", "v")
        found = exact_knn(data, asked, k, metric) if index is None else index.query(data, asked, k, metric)
        sink(found, number)

    writer = queries.writeStream.foreachBatch(handle)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()
