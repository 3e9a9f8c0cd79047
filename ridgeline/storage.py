"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of its own, but only on one machine: a cluster raises."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="ridgeline-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, outside: bool = False) -> DataFrame:
    """The same rows, from a Parquet table in the shared folder: lost executors cost no recomputation, and rows stay as first computed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ridgeline-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _scopes and not outside:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[bool]:
    """Deletes at its end what `written` has written inside, unless it was told to write outside.

    Results that are still lazy at the end must not read it.
    """
    _scopes.append([])
    try:
        yield True
    finally:
        jvm = spark.sparkContext._jvm
        for path in _scopes.pop():
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
