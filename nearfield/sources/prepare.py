"""Conversion of source files to the canonical format, by format name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfield.operators.split import hold_out
from nearfield.sources.fvecs import read_fvecs
from nearfield.sources.vector_text import read_word_vectors, write_vectors


def prepare(spark: SparkSession, kind: str, data_out: str, queries_out: str, **options) -> tuple[DataFrame, DataFrame]:
    """Writes (data, queries) canonically and returns them.

    glove: path, n, dim, n_queries, seed; the queries are held out.  sift: data, queries (two fvecs paths).
    """
    if kind == "glove":
        vectors = read_word_vectors(spark, options["path"], options["n"], options["dim"])
        data, queries = hold_out(vectors, options["n_queries"], options.get("seed", 1))
    elif kind == "sift":
        data, queries = read_fvecs(spark, options["data"]), read_fvecs(spark, options["queries"])
    else:
        raise ValueError(f"unknown source format {kind!r}: glove or sift")
    write_vectors(data, data_out)
    write_vectors(queries, queries_out)
    return data, queries
