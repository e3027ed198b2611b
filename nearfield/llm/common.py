"""Shared pieces: staged tables, word splitting, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import pickle
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts as a Java character class body.
JAVA_SPACE = r"\x20\x09-\x0D"
#: Words remembered per task; the memory is emptied when full, which costs time only.
WORD_MEMORY = 200_000


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="nearfield-")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    That is ``spark.checkpoint.dir``, or the context's checkpoint folder.  Where
    both are unset a folder of this machine serves a local master (tests);
    a cluster's executors could not see it, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: tables between steps need a folder that all executors share")
        base = _own_dir()
    return f"{base.rstrip('/')}/nearfield/{uuid.uuid4().hex}"


_open = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables staged inside, by this thread, go at the end; those that ask to stay go with the scratch around this one."""
    scopes = _open.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, stays: bool = False) -> DataFrame:
    """Cuts the lineage: writes ``df`` to the shared folder and reads it back.

    The table goes with the ``scratch`` around it, one that stays with the next one further out, and where there is none with the driver.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    scopes = _open.__dict__.setdefault("scopes", [])
    owners = scopes[:-1] if stays else scopes
    if owners:
        owners[-1].append(path)
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of a batch of whole texts, for Arrow and for Parquet, where the session still has Spark's defaults.

    Results are lazy, so the session keeps these bounds; they change no result.
    """
    bounds = (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "16777216b"),
        ("spark.sql.parquet.columnarReaderBatchSize", "4096", "512"),
    )
    for key, usual, bound in bounds:
        if spark.conf.get(key) == usual:
            spark.conf.set(key, bound)


def give_back() -> None:
    """Returns freed memory to the system; workers live on after a task and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def tidy(run):
    """A function over batches that gives memory back at its end."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def sent(spark: SparkSession, value):
    """Broadcasts ``value`` and returns the function that tasks get it by.

    Its classes travel by value, since executors may not have the repository on their path.
    """
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(data.value)


def without(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` without the columns that an operator is about to add, whatever their case."""
    return docs.drop(*(c for c in docs.columns if c.lower() in names))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; a null id falls in fold 0 as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds


class WordHashes(dict):
    """64-bit hash of each word's bytes, computed once per word and task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hashed_words(text: bytes, memory: WordHashes) -> np.ndarray:
    """Hashes of the words of ``text``: A-Z lowered, split at the six ASCII spaces."""
    words = text.lower().split()
    return np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))


#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def text_words(texts: list[bytes | None], memory: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, number of words of each text); words as in ``hashed_words``, hashed side by side, eight bytes at a time.

    Words of up to eight bytes never share a hash with others of their length.
    """
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    data = b"\n".join([*(t or b"" for t in texts), bytes(8)]).lower()
    blanks = np.flatnonzero(_BLANK[np.frombuffer(data, np.uint8)])
    starts = np.concatenate(([0], blanks[:-1] + 1)) if len(blanks) else blanks
    length = blanks - starts
    words = length > 0
    starts, length = starts[words], length[words]
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    h = length.astype(np.uint64)
    rows, at, left = slice(None), starts, length
    for k in range(LONG_WORD // 8):
        if k:
            rows = np.flatnonzero(length > 8 * k)
            at, left = starts[rows] + 8 * k, length[rows] - 8 * k
        if not len(at):
            break
        h[rows] = mixed(h[rows] * np.uint64(0xA24BAED4963EE407) + (eight[at] & _LOW_BYTES[np.minimum(left, 8)]))
    for k in np.flatnonzero(length > LONG_WORD):
        h[k] = memory[data[starts[k] : starts[k] + length[k]]]
    return h, np.diff(np.searchsorted(starts, ends), prepend=0)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def joined(parts: list[np.ndarray], salt: int) -> np.ndarray:
    """One 64-bit hash for the tuples that stand at the same places of ``parts``."""
    h = np.full(len(parts[0]), salt, np.uint64)
    for p in parts:
        h = h * np.uint64(0xA24BAED4963EE407) + p
    return mixed(h)


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def table_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
