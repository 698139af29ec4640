"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from contextlib import suppress

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeline.operators.scratch import removed, scratch, shared_dir, stored

__all__ = ["driver_returned", "heaps_returned", "lower_ascii", "removed", "scratch", "shared_dir", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory; only Spark opens the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column | str) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(F.col(c) if isinstance(c, str) else c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def driver_returned(spark: SparkSession) -> None:
    """The driver's Python and JVM collect their garbage and give what is free back to the system, native blocks too.

    Freed blocks else stay with the allocators of both, so that the driver grows from stage to stage. Where the C
    library or the JVM (before 17.0.9) knows no trimming, that part is left out.
    """
    gc.collect()  # what Python lets go of, the JVM can collect
    context = spark.sparkContext
    jvm, array = context._jvm, context._gateway.new_array
    jvm.System.gc()
    beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    trim = array(jvm.java.lang.Object, 4)
    trim[0], trim[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    trim[2], trim[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
    with suppress(Py4JJavaError):  # by its interface: the class of the beans is not open to us
        next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke").invoke(beans, trim)
    with suppress(AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def heaps_returned(spark: SparkSession) -> None:
    """Driver and executors collect their garbage and give the heap above what lives back to the system.

    A heap that has grown in one stage else stays that large while the Python workers of the next ones need their
    share of the executor's memory. One task for each core: where some are busy, an executor may be left out.
    """
    driver_returned(spark)
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()
