"""Attention share, novelty and what is obvious."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeline.functions.scalars import midrank

DAYS, LEAST_ROWS = 90, 30


def attention(coverage: DataFrame, as_of: str, days: int = DAYS, least: int = LEAST_ROWS) -> DataFrame:
    """key, share of matched articles over as_of - days to as_of, both included; null with too few rows or no norm."""
    window = coverage.filter(F.col("day").between(F.date_sub(F.lit(as_of).cast("date"), days), F.lit(as_of).cast("date")))
    sums = window.groupBy("key").agg(F.sum("matched").alias("m"), F.sum("norm").alias("n"), F.count("*").alias("rows"))
    return sums.select("key", F.when((F.col("rows") >= least) & (F.col("n") > 0), F.col("m") / F.col("n")).alias("share"))


def with_percentile(exposed: DataFrame, shares: DataFrame) -> DataFrame:
    """exposed (shock, node) with share and percentile among all exposed companies of the shock."""
    return exposed.join(shares.withColumnRenamed("key", "node"), "node", "left").withColumn("percentile", midrank("share", "shock"))


def novelty(exposure: str = "exposure", percentile: str = "percentile") -> Column:
    return F.col(exposure) * (1 - F.col(percentile))


def obvious(percentile: str = "percentile", hops: str = "hops", most: float = 0.8, few: int = 3) -> Column:
    """A known percentile decides; without one, few hops; without these, not obvious."""
    return F.when(F.col(percentile).isNotNull(), F.col(percentile) >= most).otherwise(F.coalesce(F.col(hops) <= few, F.lit(False)))


def by_novelty(found: DataFrame) -> DataFrame:
    """Largest novelty first, unknown last, then exposure, then id."""
    return found.orderBy(F.col("novelty").isNull(), F.desc(F.abs("novelty")), F.desc(F.abs("exposure")), "node")
