"""Coverage series queries over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeline.operators import attention as A
from quakeline.operators import bitemporal as T
from quakeline.operators import series as S
from quakeline.sources import binding as B

QUERIES: dict = {}
ORACLE_SQL: dict = {}
_STATS = """
WITH """ + B.COVERAGE_SQL.strip() + """,
framed AS (SELECT *, matched / norm AS share, ln((matched + 0.5) / norm) AS log_share FROM coverage),
win AS (SELECT *, count(*) OVER w AS rows_, quantile_cont(share, 0.5) OVER w AS med, sum(matched) OVER w AS sum_m, sum(norm) OVER w AS sum_n, avg(norm) OVER w AS avg_n,
  list_sort(list(matched) OVER w) AS counts, avg(tone) OVER w AS tone_m, stddev_samp(tone) OVER w AS tone_s, avg(log_share) OVER w AS ls_m, stddev_samp(log_share) OVER w AS ls_s
  FROM framed WINDOW w AS (PARTITION BY key ORDER BY day RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND INTERVAL 3 DAYS PRECEDING)),
based AS (SELECT *, greatest(CASE WHEN med * avg_n >= 0.5 THEN med ELSE (sum_m + 0.5) / sum_n END * norm, 0.5) AS expected, list_slice(counts, 1, len(counts) - CAST(floor(len(counts) * 0.1) AS INTEGER)) AS kept FROM win WHERE rows_ >= 30),
meaned AS (SELECT *, list_avg(kept) AS mean FROM based),
dispersed AS (SELECT *, CASE WHEN len(kept) < 2 OR mean <= 0 THEN 1.0 ELSE greatest(1.0, list_var_samp(kept) / mean) END AS dispersion FROM meaned),
stats AS (SELECT *, matched / expected AS ratio,
  CASE WHEN matched <= 0 THEN 0.0 WHEN matched > expected THEN least(300.0, -(-expected + matched * ln(expected) - lgamma(matched + 1)
    + ln(list_sum([exp(j * ln(expected) - (lgamma(matched + j + 1) - lgamma(matched + 1))) for j in range(0, 200)]))) / ln(10))
  ELSE -log10(greatest(1 - list_sum([exp(-expected + k * ln(expected) - lgamma(k + 1)) for k in range(0, matched)]), 1e-300)) END / dispersion AS surprise,
  CASE WHEN ls_s > 0 THEN (log_share - ls_m) / ls_s ELSE 0.0 END AS z, CASE WHEN tone_s > 0 THEN (tone - tone_m) / tone_s END AS tone_z FROM dispersed)
"""
#: A threshold that the bound series reach; they are far calmer than news.
LEVEL = 0.75
_RUNS = f""", flagged AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY key ORDER BY day) AS INTEGER) AS island FROM stats WHERE surprise >= {LEVEL} AND matched >= 2),
runs AS (SELECT key, min(day) AS start, max(day) AS end_, count(*) AS n_days, sum(matched) AS total, max(surprise) AS peak FROM flagged GROUP BY key, island HAVING count(*) >= 2)"""


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.day_stats(B.coverage(spark, sf_dir))


@query("WITH " + B.COVERAGE_SQL + " SELECT key, day, matched, CAST(norm AS BIGINT) AS norm, round(tone, 12) AS tone FROM coverage")
def q_coverage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.coverage(spark, sf_dir).select("key", "day", "matched", "norm", F.round("tone", 12).alias("tone"))


@query("WITH " + B.COVERAGE_SQL + " SELECT key, count(DISTINCT day) AS n_days, min(day) AS first, max(day) AS last FROM coverage GROUP BY key")
def q_coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.coverage(spark, sf_dir).groupBy("key").agg(F.countDistinct("day").alias("n_days"), F.min("day").alias("first"), F.max("day").alias("last"))


@query(_STATS + "SELECT key, day, rows_ AS n_rows, round(expected, 6) AS expected, round(ratio, 6) AS ratio, round(dispersion, 6) AS dispersion FROM stats")
def q_day_stats_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).select("key", "day", F.col("rows").alias("n_rows"), F.round("expected", 6).alias("expected"), F.round("ratio", 6).alias("ratio"), F.round("dispersion", 6).alias("dispersion"))


@query(_STATS + "SELECT key, day, round(z, 6) + 0.0 AS z, round(tone_z, 6) + 0.0 AS tone_z FROM stats")
def q_log_share_tone_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).select("key", "day", (F.round("z", 6) + 0.0).alias("z"), (F.round("tone_z", 6) + 0.0).alias("tone_z"))


@query(_STATS + "SELECT key, day, round(surprise, 6) + 0.0 AS surprise FROM stats")
def q_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).select("key", "day", (F.round("surprise", 6) + 0.0).alias("surprise"))


@query(_STATS + _RUNS + " SELECT key, start, end_ AS \"end\", n_days, CAST(total AS BIGINT) AS total, round(peak, 6) AS peak FROM runs")
def q_burst_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.burst_runs(_stats(spark, sf_dir), LEVEL, 2).select("key", "start", "end", "n_days", "total", F.round("peak", 6).alias("peak"))


@query()
def q_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bursts(_stats(spark, sf_dir), LEVEL, 2)


@query(_STATS + _RUNS + " SELECT key, start, end_ AS \"end\", round(peak, 6) AS peak FROM runs WHERE end_ >= DATE '2000-01-01' - 90 AND start <= DATE '2000-01-01'")
def q_trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.trending(S.burst_runs(_stats(spark, sf_dir), LEVEL, 2), "2000-01-01").select("key", "start", "end", F.round("peak", 6).alias("peak"))


_GRID = [round(0.05 * k, 2) for k in range(1, 81)]


@query(_STATS + """, grid AS (SELECT unnest(range(1, 81)) / 20.0 AS threshold),
flagged AS (SELECT threshold, key, day, day - CAST(row_number() OVER (PARTITION BY threshold, key ORDER BY day) AS INTEGER) AS island FROM stats, grid WHERE surprise >= threshold AND matched >= 5),
counted AS (SELECT threshold, count(*) AS n FROM (SELECT threshold, key, island FROM flagged GROUP BY ALL HAVING count(*) >= 2) GROUP BY threshold),
years AS (SELECT count(*) * max(span) / 365.25 AS y FROM (SELECT key, max(day) - min(day) AS span FROM stats GROUP BY key))
SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(coalesce(n, 0) AS BIGINT) AS bursts, round(coalesce(n, 0) / y, 6) AS rate FROM grid LEFT JOIN counted USING (threshold), years""")
def q_calibration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.calibration(_stats(spark, sf_dir), _GRID).select("threshold", "bursts", F.round("rate", 6).alias("rate"))


_EVENTS_SQL = ", marks AS (SELECT key || '@' || day AS event, key, day FROM stats WHERE round(tone_z, 6) <= -1.5)"


def _marks(stats: DataFrame) -> DataFrame:
    """Days of unusually bad tone stand for events; the tables have none."""
    return stats.filter(F.round("tone_z", 6) <= -1.5).select(F.concat("key", F.lit("@"), "day").alias("event"), "key", "day")


@query(_STATS + _RUNS + _EVENTS_SQL + """, near AS (SELECT event, m.key, day, start, end_, greatest(0, start - day, day - end_) AS gap FROM marks m LEFT JOIN runs r ON m.key = r.key AND day BETWEEN start - 3 AND end_ + 3)
SELECT event, key, day, start, CAST(CASE WHEN start IS NULL THEN NULL ELSE gap END AS INTEGER) AS gap, start IS NOT NULL AS hit FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY CASE WHEN start IS NULL THEN NULL ELSE gap END NULLS LAST, start) AS n FROM near) WHERE n = 1""")
def q_event_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _stats(spark, sf_dir)
    return S.event_hits(_marks(stats), S.burst_runs(stats, LEVEL, 2)).select("event", "key", "day", "start", "gap", "hit")


@query(_STATS + _RUNS + _EVENTS_SQL + " SELECT key, start FROM runs r WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.key = r.key AND m.day BETWEEN r.start - 3 AND r.end_ + 3)")
def q_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _stats(spark, sf_dir)
    return S.false_positives(_marks(stats), S.burst_runs(stats, LEVEL, 2)).select("key", "start")


@query("WITH " + B.COVERAGE_SQL + " SELECT key, CASE WHEN count(*) >= 30 THEN round(sum(matched) / sum(norm), 9) END AS share FROM coverage WHERE day BETWEEN DATE '2000-01-01' - 90 AND DATE '2000-01-01' GROUP BY key")
def q_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.attention(B.coverage(spark, sf_dir), "2000-01-01").select("key", F.round("share", 9).alias("share"))


@query("WITH " + B.VERSIONS_SQL + " SELECT key, day, matched, recorded_on FROM (SELECT *, row_number() OVER (PARTITION BY key, day ORDER BY recorded_on DESC, row_id DESC) AS n FROM versions WHERE recorded_on <= DATE '1999-06-30') WHERE n = 1")
def q_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.versions(spark, sf_dir).filter("recorded_on <= date'1999-06-30'")
    return T.latest(rows, ["key", "day"], F.desc("recorded_on"), F.desc("row_id")).select("key", "day", "matched", "recorded_on")


@query("WITH " + B.VERSIONS_SQL + """, newest AS (SELECT key, query_hash FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY recorded_on DESC, row_id DESC) AS n FROM versions) WHERE n = 1)
SELECT key, day, matched FROM (SELECT v.*, row_number() OVER (PARTITION BY key, day ORDER BY recorded_on DESC, row_id DESC) AS n FROM versions v JOIN newest USING (key, query_hash)) WHERE n = 1""")
def q_latest_query_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.series(B.versions(spark, sf_dir)).select("key", "day", "matched")


@query("""SELECT count(*) AS events, round(avg(CAST(l_returnflag = 'R' AS INTEGER)), 6) AS hit_rate, round(avg(CAST(l_returnflag = 'R' AS INTEGER)) FILTER (WHERE l_linestatus <> 'O'), 6) AS exact_hit_rate,
  round(avg(CAST((l_tax > 0.04) = (l_discount > 0.05) AS INTEGER)) FILTER (WHERE l_returnflag = 'R'), 6) AS flag_precision, avg(CAST(l_returnflag = 'R' AS INTEGER)) >= 0.25 AS met FROM lineitem""")
def q_event_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = B.read(spark, sf_dir, "lineitem")
    hits = line.select((F.col("l_returnflag") == "R").alias("hit"), (F.col("l_linestatus") == "O").alias("approximate"), (F.col("l_discount") > 0.05).alias("reversal"), (F.col("l_tax") > 0.04).alias("tone_flag"))
    return S.event_report(hits, 0.25).select("events", *(F.round(c, 6).alias(c) for c in ("hit_rate", "exact_hit_rate", "flag_precision")), "met")


@query(_STATS + """, held AS (SELECT key, count(*) AS days FROM coverage GROUP BY key), wanted AS (SELECT DISTINCT o_orderpriority AS key FROM orders UNION SELECT c_mktsegment FROM customer),
judged AS (SELECT key, bool_or(day BETWEEN DATE '2001-10-15' - 90 AND DATE '2001-10-15') AS recent FROM stats GROUP BY key)
SELECT key, CASE WHEN days IS NULL THEN 'no coverage' WHEN recent IS NULL THEN 'too few days' ELSE 'no days in the window' END AS reason FROM wanted LEFT JOIN held USING (key) LEFT JOIN judged USING (key) WHERE recent IS NOT TRUE""")
def q_trending_unmeasured(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = B.read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key")).union(B.read(spark, sf_dir, "customer").select("c_mktsegment"))
    return S.unmeasured(keys, B.coverage(spark, sf_dir), _stats(spark, sf_dir), "2001-10-15")
