"""Shared scratch space of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables stored inside each open `scratch` block, the innermost last.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder: spark.checkpoint.dir, or one of our own where unset (local runs only)."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
    if not named:
        named = tempfile.mkdtemp(prefix="quakeline-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return context.getCheckpointDir() or named


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: compact, prunable, safe against lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quakeline-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside the block go at its end: results that read them must be written before."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            removed(spark, path)
