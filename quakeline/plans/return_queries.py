"""Event-study queries over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeline.operators import returns as R
from quakeline.sources import binding as B

QUERIES: dict = {}
ORACLE_SQL: dict = {}
CALENDAR, HORIZON = "Brand#11", 20
_WITH = "WITH " + B.PRICES_SQL.strip() + f""",
cal AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS idx FROM (SELECT DISTINCT day FROM prices WHERE listing = '{CALENDAR}')),
detections AS (SELECT 'e' || (detected - DATE '1970-01-01') AS event, detected FROM (SELECT DISTINCT day AS detected FROM prices)),
spans AS (SELECT event, detected, s.day AS start, e.day AS end_ FROM (SELECT event, detected, min(idx) AS i FROM detections JOIN cal ON day > detected GROUP BY ALL) x JOIN cal s ON s.idx = i JOIN cal e ON e.idx = i + {HORIZON}),
priced AS (SELECT *, adj_close * fx AS value FROM usd),
ent AS (SELECT event, detected, end_, listing, min(p.day) AS d FROM spans JOIN priced p ON p.day > detected AND p.day <= detected + 5 GROUP BY ALL),
ext AS (SELECT event, listing, max(p.day) AS d FROM spans JOIN priced p ON p.day <= end_ AND p.day >= end_ - 5 GROUP BY ALL),
legs AS (SELECT event, ent.listing, a.day AS entry_day, b.day AS exit_day, a.value AS v0, b.value AS v1, a.adj_close AS a0, b.adj_close AS a1 FROM ent JOIN ext USING (event, listing)
  JOIN priced a ON a.listing = ent.listing AND a.day = ent.d JOIN priced b ON b.listing = ext.listing AND b.day = ext.d WHERE ext.d > ent.d),
outcomes AS (SELECT *, v1 / v0 - 1 AS r, a1 / a0 - 1 AS local, avg(v1 / v0 - 1) OVER (PARTITION BY event) AS bench FROM legs WHERE v0 > 0 AND v1 IS NOT NULL),
rets AS (SELECT listing, day, value / prev - 1 AS r FROM (SELECT listing, day, value, lag(value) OVER (PARTITION BY listing ORDER BY day) AS prev FROM priced) WHERE value <> 0 AND prev <> 0),
abnormal AS (SELECT listing, day, r - avg(r) OVER (PARTITION BY day) AS abnormal FROM rets)
"""


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = _WITH + sql
        return f

    return register


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.in_usd(B.prices(spark, sf_dir), B.rates(spark, sf_dir))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = B.prices(spark, sf_dir)
    days = prices.select(F.col("day").alias("detected")).distinct()
    return R.windows(days.select(F.concat(F.lit("e"), F.unix_date("detected")).alias("event"), "detected"), R.calendar(prices, CALENDAR), HORIZON)


@query("SELECT event, detected, start, end_ AS \"end\" FROM spans")
def q_calendar_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir)


@query("SELECT listing, day, round(ln(value), 8) + 0.0 AS log_usd FROM priced")
def q_fx_usd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir).select("listing", "day", (F.round(F.log("usd"), 8) + 0.0).alias("log_usd"))


@query("SELECT event, listing, entry_day, exit_day FROM legs")
def q_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.legs(_priced(spark, sf_dir), _spans(spark, sf_dir)).select("event", "listing", F.col("entry.day").alias("entry_day"), F.col("exit.day").alias("exit_day"))


@query("SELECT event, listing, round(r, 8) AS usd_return, round(local, 8) AS local_return, round(bench, 8) AS benchmark, round(r - bench, 8) + 0.0 AS abnormal FROM outcomes")
def q_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.outcomes(R.legs(_priced(spark, sf_dir), _spans(spark, sf_dir)))
    return found.select("event", "listing", *(F.round(c, 8).alias(c) for c in ("usd_return", "local_return", "benchmark")), (F.round("abnormal", 8) + 0.0).alias("abnormal"))


@query("SELECT listing, day, round(abnormal, 8) + 0.0 AS abnormal FROM abnormal")
def q_daily_abnormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.daily_abnormal(_priced(spark, sf_dir)).select("listing", "day", (F.round("abnormal", 8) + 0.0).alias("abnormal"))


@query(", " + B.COVERAGE_SQL + """, pairs AS (SELECT key, listing, abnormal, matched / norm AS share FROM abnormal JOIN coverage USING (day)),
ranks AS (SELECT key, listing, rank() OVER (PARTITION BY key, listing ORDER BY abnormal) + (count(*) OVER (PARTITION BY key, listing, abnormal) - 1) / 2 AS ra,
  rank() OVER (PARTITION BY key, listing ORDER BY share) + (count(*) OVER (PARTITION BY key, listing, share) - 1) / 2 AS rs FROM pairs)
SELECT key, listing, CASE WHEN count(*) >= 40 THEN round(corr(ra, rs), 6) END AS rho FROM ranks GROUP BY key, listing""")
def q_priced_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = B.coverage(spark, sf_dir).select("key", "day", (F.col("matched") / F.col("norm")).alias("share"))
    return R.priced_in(R.daily_abnormal(_priced(spark, sf_dir)), shares).select("key", "listing", F.round("rho", 6).alias("rho"))


@query(", " + B.COVERAGE_SQL + """, last60 AS (SELECT day FROM cal WHERE day <= DATE '2000-06-30' ORDER BY day DESC LIMIT 60),
pairs AS (SELECT key, listing, abnormal, matched / norm AS share FROM abnormal JOIN coverage USING (day) WHERE day IN (SELECT day FROM last60)),
ranks AS (SELECT key, listing, rank() OVER (PARTITION BY key, listing ORDER BY round(abnormal, 12)) + (count(*) OVER (PARTITION BY key, listing, round(abnormal, 12)) - 1) / 2 AS ra,
  rank() OVER (PARTITION BY key, listing ORDER BY share) + (count(*) OVER (PARTITION BY key, listing, share) - 1) / 2 AS rs FROM pairs)
SELECT key, listing, CASE WHEN count(*) >= 5 THEN round(corr(ra, rs), 6) END AS rho FROM ranks GROUP BY key, listing""")
def q_priced_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = B.coverage(spark, sf_dir).select("key", "day", (F.col("matched") / F.col("norm")).alias("share"))
    within = R.last_days(R.calendar(B.prices(spark, sf_dir), CALENDAR), "2000-06-30")
    daily = R.daily_abnormal(_priced(spark, sf_dir)).withColumn("abnormal", F.round("abnormal", 12))
    return R.priced_in(daily, shares, 5, within).select("key", "listing", F.round("rho", 6).alias("rho"))
