"""Coverage series: day statistics against a trailing baseline, bursts, trends, calibration, event checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakeline.functions.scalars import day_number, poisson_surprise
from quakeline.operators.scratch import stored

# Fixed values of the method.
BACK, GAP, LEAST_DAYS = 90, 3, 30
LEAST_EXPECTED, LEAST_MATCHED, PERSISTENCE, TRIM = 0.5, 5, 2, 0.10
THRESHOLD, TONE_FLAG, SPLIT_DEPTH = 1.75, -2.0, 0.5


def baseline(*keys: str) -> Column:
    """Rows of the same key from BACK to GAP days before, by date: gaps shorten the window."""
    return W.partitionBy(*keys).orderBy(day_number()).rangeBetween(-BACK, -GAP)


def day_stats(coverage: DataFrame) -> DataFrame:
    """key, day, matched, norm, tone with rows, expected, ratio, dispersion, surprise, z, tone_z; days with LEAST_DAYS only."""
    w = baseline("key")
    share = F.when(F.col("norm") > 0, F.col("matched") / F.col("norm")).otherwise(0.0)
    x = coverage.withColumns({"share": share, "log_share": F.when(F.col("norm") > 0, F.log((F.col("matched") + 0.5) / F.col("norm"))).otherwise(0.0)})
    x = x.withColumns({
        "rows": F.count("*").over(w), "med": F.percentile("share", F.lit(0.5)).over(w), "sum_m": F.sum("matched").over(w), "sum_n": F.sum("norm").over(w), "avg_n": F.avg("norm").over(w),
        "counts": F.array_sort(F.collect_list("matched").over(w)), "tones": F.count("tone").over(w), "tone_m": F.avg("tone").over(w), "tone_s": F.stddev_samp("tone").over(w),
        "ls_m": F.avg("log_share").over(w), "ls_s": F.stddev_samp("log_share").over(w),
    }).filter(F.col("rows") >= LEAST_DAYS)
    base = F.when(F.col("med") * F.col("avg_n") >= 0.5, F.col("med")).otherwise((F.col("sum_m") + 0.5) / F.col("sum_n"))
    x = x.withColumn("expected", F.greatest(base * F.col("norm"), F.lit(LEAST_EXPECTED))).withColumn("ratio", F.col("matched") / F.col("expected"))
    kept = F.slice("counts", F.lit(1), F.size("counts") - F.floor(F.size("counts") * TRIM).cast("int"))
    x = x.withColumn("kept", kept).withColumn("mean", F.aggregate("kept", F.lit(0.0), lambda a, v: a + v) / F.size("kept"))
    var = F.aggregate("kept", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean"))) / (F.size("kept") - 1)
    x = x.withColumn("dispersion", F.when((F.size("kept") < 2) | (F.col("mean") <= 0), 1.0).otherwise(F.greatest(F.lit(1.0), var / F.col("mean"))))
    x = x.withColumn("surprise", poisson_surprise(F.col("matched"), F.col("expected")) / F.col("dispersion"))
    z = F.when(F.coalesce(F.col("ls_s"), F.lit(0.0)) > 0, (F.col("log_share") - F.col("ls_m")) / F.col("ls_s")).otherwise(0.0)
    tone_z = F.when(F.col("tone").isNull() | (F.col("tones") < 2), None).when(F.col("tone_s") > 0, (F.col("tone") - F.col("tone_m")) / F.col("tone_s"))
    x = x.select("key", "day", "matched", "norm", "tone", "rows", "expected", "ratio", "dispersion", "surprise", z.alias("z"), tone_z.alias("tone_z"))
    return stored(x)  # once for all that is asked of it: a filter on surprise would otherwise be pushed below and repeat its sums


def runs(stats: DataFrame, threshold: Column | float = THRESHOLD, *keys: str, least: int = LEAST_MATCHED) -> DataFrame:
    """Days over the threshold with run: the first day of their stretch of consecutive days."""
    by = ["key", *keys]
    over = stats.filter((F.col("surprise") >= threshold) & (F.col("matched") >= least))
    island = F.date_sub("day", F.row_number().over(W.partitionBy(*by).orderBy("day")))
    return over.withColumn("island", island).withColumn("run", F.min("day").over(W.partitionBy(*by, "island"))).drop("island")


def _bursts(days: DataFrame, *by: str) -> DataFrame:
    first = F.struct(F.col("surprise"), (-F.unix_date("day")).alias("d"))
    top = lambda c: F.max_by(c, first)
    out = days.groupBy(*by).agg(F.min("day").alias("start"), F.max("day").alias("end"), F.count("*").alias("n_days"), F.sum("matched").alias("total"), top("day").alias("peak_day"), F.max("surprise").alias("peak"), top("ratio").alias("peak_ratio"), top("tone_z").alias("peak_tone_z"))
    return out.filter(F.col("n_days") >= PERSISTENCE).withColumn("tone_flag", F.coalesce(F.col("peak_tone_z") <= TONE_FLAG, F.lit(False)))


def burst_runs(stats: DataFrame, threshold: float = THRESHOLD, least: int = LEAST_MATCHED) -> DataFrame:
    """Bursts without the split at troughs."""
    return _bursts(runs(stats, threshold, least=least), "key", "run").drop("run")


def split_points(surprise: list[float], persistence: int = PERSISTENCE, depth: float = SPLIT_DEPTH) -> list[int]:
    """Places where a run is cut in two, and its parts again: the lowest day between two higher stretches.

    A day is a trough if it falls to `depth` of the lower of the peaks before it and from it on; it opens the later part.
    """
    out, todo = [], [(0, len(surprise))]
    while todo:
        lo, hi = todo.pop()
        left = np.maximum.accumulate(surprise[lo:hi])
        right = np.maximum.accumulate(surprise[lo:hi][::-1])[::-1]
        inner = np.arange(persistence, hi - lo - persistence + 1)
        if not len(inner):
            continue
        depths = np.asarray(surprise[lo:hi])[inner] / np.minimum(left[inner - 1], right[inner])
        if depths.min() <= depth:
            at = lo + int(inner[depths.argmin()])
            out.append(at)
            todo += [(lo, at), (at, hi)]
    return sorted(out)


def bursts(stats: DataFrame, threshold: float = THRESHOLD, least: int = LEAST_MATCHED) -> DataFrame:
    """key, start, end, n_days, total, peak_day, peak, peak_ratio, peak_tone_z, tone_flag; runs are split at troughs.

    A run has as many rows as days; each is cut by itself.
    """
    days = runs(stats, threshold, least=least)
    fields = T.StructType([*days.schema, T.StructField("part", T.IntegerType())])

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        points = split_points(pdf.surprise.tolist())
        return pdf.assign(part=[sum(p <= i for p in points) for i in range(len(pdf))])[[f.name for f in fields]]

    return _bursts(days.groupBy("key", "run").applyInPandas(cut, fields), "key", "run", "part").drop("run", "part")


def trending(found: DataFrame, as_of: str, window: int = 90) -> DataFrame:
    """Bursts that end within the window, the strongest first."""
    return found.filter((F.col("end") >= F.date_sub(F.lit(as_of).cast("date"), window)) & (F.col("start") <= F.lit(as_of).cast("date"))).orderBy(F.desc("peak"), "key", "start")


def unmeasured(keys: DataFrame, coverage: DataFrame, stats: DataFrame, as_of: str, window: int = 90) -> DataFrame:
    """key, reason of the keys that trending can't judge: no coverage at all, too few days for a baseline, or none in the window."""
    held = coverage.groupBy("key").agg(F.count("*").alias("days"))
    judged = stats.groupBy("key").agg(F.max(F.col("day").between(F.date_sub(F.lit(as_of).cast("date"), window), F.lit(as_of).cast("date"))).alias("recent"))
    each = keys.select("key").distinct().join(held, "key", "left").join(judged, "key", "left")
    reason = F.when(F.col("days").isNull(), "no coverage").when(F.col("recent").isNull(), "too few days").when(~F.col("recent"), "no days in the window")
    return each.select("key", reason.alias("reason")).filter("reason is not null")


def event_report(hits: DataFrame, least_rate: float = 0.6) -> DataFrame:
    """events, hit_rate, exact_hit_rate, flag_precision, met over hits (hit, approximate, reversal, tone_flag).

    Rates of nothing are 0. Of the events that a burst matched, the flag is right if it fires on reversals only; the
    precision of no match is null.
    """
    rate = lambda flag, of: F.coalesce(F.avg(F.when(of, flag.cast("int"))), F.lit(0.0))
    hit, true = F.col("hit"), F.lit(True)
    right = F.coalesce("tone_flag", F.lit(False)) == F.col("reversal")
    out = hits.agg(F.count("*").alias("events"), rate(hit, true).alias("hit_rate"), rate(hit, ~F.col("approximate")).alias("exact_hit_rate"), F.avg(F.when(hit, right.cast("int"))).alias("flag_precision"))
    return out.withColumn("met", F.col("hit_rate") >= least_rate)


def calibration(stats: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, bursts, rate (bursts per key and year) for each threshold, all in one plan over the same statistics."""
    grid = stats.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    # only days over the least threshold can ever count; the grid is a short list given by the caller
    days = stats.filter(F.col("surprise") >= min(thresholds)).crossJoin(F.broadcast(grid))
    counts = _bursts(runs(days, F.col("threshold"), "threshold"), "threshold", "key", "run").groupBy("threshold").agg(F.count("*").alias("bursts"))
    spans = stats.groupBy("key").agg(F.datediff(F.max("day"), F.min("day")).alias("span")).agg((F.count("*") * F.max("span") / 365.25).alias("years"))
    return grid.join(counts, "threshold", "left").crossJoin(F.broadcast(spans)).select("threshold", F.coalesce("bursts", F.lit(0)).alias("bursts"), (F.coalesce("bursts", F.lit(0)) / F.col("years")).alias("rate"))


def chosen_threshold(curve: DataFrame, most: float = 4.0) -> DataFrame:
    """The least threshold whose rate is low enough."""
    return curve.filter(F.col("rate") <= most).agg(F.min("threshold").alias("threshold"))


def event_hits(events: DataFrame, found: DataFrame, tolerance: int = 3) -> DataFrame:
    """event, key, day with the burst that covers it or is nearest within tolerance (start, end, gap), hit."""
    spans = found.select(F.col("key").alias("k"), "start", "end")
    near = (F.col("key") == F.col("k")) & F.col("at").between(F.date_sub("start", tolerance), F.date_add("end", tolerance))
    joined = events.withColumnRenamed("day", "at").join(spans, near, "left")
    gap = F.when(F.col("start").isNull(), None).otherwise(F.greatest(F.lit(0), F.datediff("start", "at"), F.datediff("at", "end")))
    joined = joined.withColumn("gap", gap)
    first = joined.withColumn("n", F.row_number().over(W.partitionBy("event").orderBy(F.col("gap").asc_nulls_last(), "start"))).filter("n = 1")
    return first.select("event", "key", F.col("at").alias("day"), "start", "end", "gap", F.col("start").isNotNull().alias("hit"))


def false_positives(events: DataFrame, found: DataFrame, tolerance: int = 3) -> DataFrame:
    """Bursts near no event of their key."""
    e = events.select(F.col("key").alias("k"), F.col("day").alias("at"))
    return found.join(e, (F.col("key") == F.col("k")) & F.col("at").between(F.date_sub("start", tolerance), F.date_add("end", tolerance)), "left_anti")


def twins(hits: DataFrame) -> DataFrame:
    """event, twin: another event of the key that the same burst covers, the first by name."""
    other = hits.select(F.col("event").alias("twin"), F.col("key").alias("k"), F.col("start").alias("s"))
    pairs = hits.filter("hit").join(other, (F.col("key") == F.col("k")) & (F.col("start") == F.col("s")) & (F.col("event") != F.col("twin")))
    return pairs.groupBy("event").agg(F.min("twin").alias("twin"))
