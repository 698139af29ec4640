"""Event study on forty weekdays."""

from datetime import date, timedelta

import pytest

from quakeline.operators import returns as R

DAYS = [d for d in (date(2025, 1, 6) + timedelta(n) for n in range(60)) if d.weekday() < 5][:40]


def prices(spark, levels, rates=()):
    rows = [(n, d, float(p(i)), float(p(i)), c) for n, (c, p) in levels.items() for i, d in enumerate(DAYS)]
    fx = spark.createDataFrame(list(rates) or [("EUR", DAYS[0], 1.0)], "currency string, day date, rate double")
    return R.in_usd(spark.createDataFrame(rows, "listing string, day date, close double, adj_close double, currency string"), fx)


def test_windows_and_abnormal_returns(spark):
    priced = prices(spark, {"CAL": ("USD", lambda i: 1), "A": ("USD", lambda i: 110 if i > 9 else 100), "B": ("USD", lambda i: 100), "C": ("USD", lambda i: 100), "D": ("USD", lambda i: 100)})
    days = R.calendar(priced, "CAL")
    span = R.windows(spark.createDataFrame([("e", DAYS[4]), ("late", DAYS[35])], "event string, detected date"), days, 10).collect()
    assert [(r.event, r.start, r.end) for r in span] == [("e", DAYS[5], DAYS[15])]
    spans = spark.createDataFrame(span)
    out = {r.listing: r for r in R.outcomes(R.legs(priced.filter("listing <> 'CAL'"), spans)).collect()}
    assert out["A"].abnormal == pytest.approx(0.075) and out["B"].abnormal == pytest.approx(-0.025) and out["A"].benchmark == pytest.approx(0.025)


def test_currency(spark):
    rates = [("EUR", d, 1.0 if i < 10 else 1.1) for i, d in enumerate(DAYS)]
    priced = prices(spark, {"E": ("EUR", lambda i: 100), "X": ("CHF", lambda i: 1)}, rates)
    spans = spark.createDataFrame([("e", DAYS[4], DAYS[5], DAYS[15])], "event string, detected date, start date, end date")
    out = R.outcomes(R.legs(priced, spans)).collect()
    assert [(r.listing, round(r.usd_return, 9), round(r.local_return, 9)) for r in out] == [("E", 0.1, 0.0)]
