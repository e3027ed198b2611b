"""The fvecs binary format: records of an int32 length and as many float32, little-endian."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def decode(content: bytes) -> np.ndarray:
    if not content:
        return np.zeros((0, 0), np.float32)
    dim = int(np.frombuffer(content, "<i4", 1)[0])
    if dim <= 0 or len(content) % (4 + 4 * dim):
        raise ValueError("no fvecs content")
    records = np.frombuffer(content, "<i4").reshape(-1, dim + 1)
    if (records[:, 0] != dim).any():
        raise ValueError("records of several lengths")
    return records[:, 1:].view("<f4")


def encode(rows: np.ndarray) -> bytes:
    rows = np.asarray(rows, "<f4")
    return np.hstack([np.full((len(rows), 1), rows.shape[1], "<i4"), rows.view("<i4")]).tobytes()


def record_length(spark: SparkSession, path: str) -> int:
    """Bytes of a record, from the first one of the first file with content; 0 where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((str(f.getPath()), f.getLen()) for f in (fs.globStatus(p) or ()) for f in ([f] if f.isFile() else fs.listStatus(f.getPath())))
    for name, size in files:
        if size:
            stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(name))
            try:
                head = [stream.readByte() & 255 for _ in range(4)]
            finally:
                stream.close()
            dim = int.from_bytes(bytes(head), "little", signed=True)
            if dim <= 0:
                raise ValueError("no fvecs content")
            return 4 + 4 * dim
    return 0


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """(id, v) of one or more files: ids from 0 through the files in path order.

    All records have one length, so Spark splits large files between them; no
    file is held whole anywhere.
    """
    length = record_length(spark, path)
    if not length:
        return spark.createDataFrame([], "id long, v array<double>")
    records = spark.sparkContext.binaryRecords(path, length).zipWithIndex().map(lambda r: (r[1], bytearray(r[0])))
    rows = spark.createDataFrame(records, "id long, record binary")
    schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            if b.num_rows:
                found = decode(b"".join(b.column(1).to_pylist())).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(found), pa.list_(pa.float64()))], schema=schema)

    return rows.mapInArrow(run, "id long, v array<double>")


def write_fvecs(vectors: DataFrame, path: str, rows_at_once: int = 4096) -> None:
    """One file of all rows in id order, streamed through the driver a few thousand rows at a time."""
    spark = vectors.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    held: list[list[float]] = []
    try:
        for r in vectors.orderBy("id").select("v").toLocalIterator(prefetchPartitions=True):
            held.append(r["v"])
            if len(held) == rows_at_once:
                out.write(bytearray(encode(np.array(held))))
                held.clear()
        if held:
            out.write(bytearray(encode(np.array(held))))
    finally:
        out.close()
