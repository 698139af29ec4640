"""Bursts of synthetic series, attention, versions."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quakeline.functions.scalars import midrank, poisson_surprise
from quakeline.operators import bitemporal as T
from quakeline.operators import series as S

FIRST = date(2023, 3, 1)
_rng = random.Random(77)
CALM = [_rng.randint(55, 70) for _ in range(130)]
# counts of a day, and the first days of the bursts that are expected
CASES = {
    "calm": ([62] * 180, []), "plateau": (CALM + [640] * 6 + CALM[:30], [130]), "one day": (CALM + [900] + CALM[:30], []), "rare": ([0, 2, 1, 0, 1, 3, 0] * 25 + [3, 3, 2, 3], []), "woken": ([0] * 140 + [2, 2], []),
    "from nothing": ([0] * 140 + [150] * 5, [140]), "twice": (CALM + [700] * 4 + CALM[:7] + [650] * 3 + CALM[:20], [130, 141]), "trough": (CALM + [800, 820, 790, 180, 810, 805, 790, 800] + CALM[:20], [130, 133]),
    "ebbing": (CALM + [800, 610, 430, 290, 230] + CALM[:20], [130]), "gap of a day": (CALM + [700, 700, 60, 700, 700] + CALM[:20], [130, 133]),
}


@pytest.fixture(scope="module")
def stats(spark):
    rows = [(k, FIRST + timedelta(n), c, 800_000, None) for k, (counts, _) in CASES.items() for n, c in enumerate(counts)]
    return S.day_stats(spark.createDataFrame(rows, "key string, day date, matched long, norm long, tone double")).cache()


def test_bursts(stats):
    found = S.bursts(stats).collect()
    assert {k: sorted((r.start - FIRST).days for r in found if r.key == k) for k in CASES} == {k: days for k, (_, days) in CASES.items()}
    plateau = next(r for r in found if r.key == "plateau")
    assert plateau.n_days == 6 and plateau.end == plateau.start + timedelta(5) and plateau.total == 6 * 640 and abs(plateau.peak_ratio - 640 / sorted(CALM)[65]) < 0.6


def test_a_single_day_surprises(stats):
    assert stats.filter("key = 'one day'").agg({"surprise": "max"}).first()[0] >= S.THRESHOLD
    assert stats.filter("key = 'woken'").agg({"expected": "min"}).first()[0] >= S.LEAST_EXPECTED


def test_calibration_counts_bursts_without_the_split(stats):
    curve = {r.threshold: r.bursts for r in S.calibration(stats, [0.5, 1.75, 50.0]).collect()}
    assert curve == {t: S.burst_runs(stats, t).count() for t in curve}


def test_trending_and_what_was_not_measured(spark, stats):
    as_of = str(FIRST + timedelta(140))
    keys = spark.createDataFrame([("plateau",), ("calm",), ("unknown",), ("short",)], "key string")
    few = spark.createDataFrame([("short", FIRST)], "key string, day date")
    rows = stats.select("key", "day").union(few)
    assert {r.key: r.reason for r in S.unmeasured(keys, rows, stats, as_of).collect()} == {"unknown": "no coverage", "short": "too few days"}
    assert {r.key for r in S.trending(S.bursts(stats), as_of).collect()} >= {"plateau", "trough"}


def test_event_report(spark):
    rows = [("a", True, False, False, False), ("b", True, False, True, True), ("c", False, True, False, None), ("d", True, True, False, True)]
    hits = spark.createDataFrame(rows, "event string, hit boolean, approximate boolean, reversal boolean, tone_flag boolean")
    r = S.event_report(hits, 0.7).first()
    assert (r.events, r.hit_rate, r.exact_hit_rate, r.met) == (4, 0.75, 1.0, True) and r.flag_precision == pytest.approx(2 / 3)
    none = S.event_report(hits.limit(0)).first()
    assert (none.events, none.hit_rate, none.flag_precision) == (0, 0.0, None)


def test_midrank(spark):
    rows = [("p", 4.0), ("p", 9.0), ("p", 9.0), ("p", 9.0), ("p", 12.0), ("q", 2.5), ("r", None), ("r", 3.0), ("r", 1.0)]
    found = spark.createDataFrame(rows, "k string, v double").withColumn("p", midrank("v", "k")).collect()

    def want(v, own):
        below, same = sum(x < v for x in own), sum(x == v for x in own)
        return (below + (same - 1) / 2) / (len(own) - 1) if len(own) > 1 else 0.0

    groups = {k: [v for g, v in rows if g == k and v is not None] for k in "pqr"}
    assert all(r.p == (None if r.v is None else pytest.approx(want(r.v, groups[r.k]))) for r in found)


def test_versions(spark):
    cols = "key string, hash string, recorded_at timestamp, superseded_at timestamp"
    new = lambda rows: spark.createDataFrame(rows, "key string, hash string")
    store = T.apply_versions(spark.createDataFrame([], cols), new([("k1", "x"), ("k2", "x")]), ["key"], "2022-05-01")
    store = T.apply_versions(store, new([("k1", "x"), ("k3", "y")]), ["key"], "2022-08-01")
    rows = sorted((r.key, r.superseded_at is not None) for r in store.collect())
    assert rows == [("k1", False), ("k2", True), ("k3", False)]
    assert {r.key for r in store.filter(T.known_at("2022-06-15")).collect()} == {"k1", "k2"}
    diff = T.version_diff(new([("k1", "x"), ("k2", "x")]), new([("k1", "z"), ("k3", "y")]), "key").selectExpr("sum(int(inserted))", "sum(int(superseded))", "sum(int(unchanged))").first()
    assert tuple(diff) == (2, 2, 0)


def test_versions_of_one_source_leave_the_others(spark):
    cols = "source string, key string, hash string, recorded_at timestamp, superseded_at timestamp"
    rows = lambda x: spark.createDataFrame(x, "source string, key string, hash string")
    store = T.apply_versions(spark.createDataFrame([], cols), rows([("s", "a", "1"), ("t", "a", "1"), ("t", "b", "1")]), ["source", "key"], "2022-05-01")
    store = T.load_source(store, rows([("s", "c", "1")]), ["source", "key"], "2022-06-01", "s")
    assert {(r.source, r.key) for r in store.filter("superseded_at is null").collect()} == {("s", "c"), ("t", "a"), ("t", "b")}
    with pytest.raises(ValueError, match="E9"):
        T.load_source(store, rows([("s", "c", "2")]), ["source", "key"], "2022-07-01", "s", spark.createDataFrame([("E9", "x")], "rule string, message string"))


def test_precedence_agrees_with_picking_one_by_one(spark):
    rng, rows = random.Random(4), []
    for k in range(12):
        for i in range(rng.randint(1, 9)):
            rows.append((f"k{k}", rng.random() < 0.3, rng.choice(["filing", "manual", "bucket"]), date(2021, 1, 1) + timedelta(rng.randrange(400)), rng.randrange(3), f"r{k}-{i}"))
    df = spark.createDataFrame(rows, "k string, trusted boolean, weight_source string, valid_from date, source_order int, row_id string")
    got = {k: [r.row_id for r in sorted(T.precedence(df, ["k"]).filter(F.col("k") == k).collect(), key=lambda r: r.rank_in_key)] for k in ("k0", "k3", "k7", "k11")}
    for k, order in got.items():
        left, want = df.filter(F.col("k") == k), []
        while (first := T.winners(left, ["k"]).first()) is not None:
            want.append(first.row_id)
            left = left.filter(~F.col("row_id").isin(want))
        assert order == want


def test_precedence_of_keys_over_many_batches(spark):
    """Keys of one row up to more than a batch, missing keys and orders, in the order of the batches that Spark makes; no pandas frame a key."""
    keys, day = ["a", None, *(f"k{i}" for i in range(300))], date(2021, 1, 1)
    rows = [(k, "p", i % 2 == 0, "filing", day + timedelta(i * 7 % 50), None if i == 3 else i % 3, f"r{i:05d}") for k in keys for i in range(1_500 if k == "a" else 7)]
    df = spark.createDataFrame(rows, "k string, q string, trusted boolean, weight_source string, valid_from date, source_order int, row_id string").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = T.precedence(df, ["k", "q"])
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == len(rows)
    for k in keys:
        own = sorted((r for r in got if r.k == k), key=lambda r: r.rank_in_key)
        # all days are within reach of each other, so order within a class is by source, then the newest
        want = sorted((r for r in rows if r[0] == k), key=lambda r: (not r[2], -1 if r[5] is None else r[5], -r[4].toordinal(), -int(r[6][1:])))
        assert [(r.row_id, r.rank_in_key) for r in own] == [(r[6], i + 1) for i, r in enumerate(want)]


def test_surprise_of_large_counts(spark):
    """At and below means whose exp(-mean) underflows, against sums of logarithms."""
    rows = [(m, x) for x in (0.5, 3.0, 12.0, 700.0, 746.0, 800.0, 5000.0) for m in sorted({1, 2, int(x), int(x - x**0.5), int(x + x**0.5)}) if m > 0]

    def want(m, x):
        tail = lambda ks: math.fsum(math.exp(-x + k * math.log(x) - math.lgamma(k + 1)) for k in ks)
        return -math.log10(tail(range(m, m + 2000)) if m > x else 1 - tail(range(m)))

    got = spark.createDataFrame(rows, "m int, x double").select("m", "x", poisson_surprise(F.col("m"), F.col("x")).alias("s")).collect()
    assert {(r.m, r.x): r.s for r in got} == pytest.approx({(m, x): want(m, x) for m, x in rows}, abs=1e-8)
    assert {(r.m, r.x): r.s for r in got}[(800, 800.0)] > 0.29
