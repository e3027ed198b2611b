"""Folders for files that a query writes and reads again."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


@functools.cache
def _own() -> str:
    return "file://" + tempfile.mkdtemp(prefix="nearfield-")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share; it goes with the driver.

    Where that and the context's checkpoint folder are unset, a folder of this
    machine serves a local master alone: a cluster's executors could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: files between steps need a folder that all executors share")
        base = _own()
    path = f"{base.rstrip('/')}/nearfield/{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    fs.deleteOnExit(p)
    return path
