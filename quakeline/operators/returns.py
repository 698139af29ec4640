"""Event study: trading windows, legs, currency, benchmarks, abnormal returns, what is priced in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quakeline.functions.scalars import average_rank

SLACK = 5
PRICED_IN_DAYS, PRICED_IN_LEAST = 60, 40
#: Days that are broadcast as bounds of a window.
MOST_DAYS = 100_000
# The market of a listing by its ending, the index of a market, how a currency's rate is quoted.
MARKETS = {"T": "JP", "KS": "KR", "DE": "DE", "PA": "FR"}
INDEXES = {"US": "^GSPC", "JP": "^N225", "KR": "^KS11", "DE": "^GDAXI", "FR": "^FCHI"}
RATES = {"JPY": ("JPY=X", "divide"), "KRW": ("KRW=X", "divide"), "EUR": ("EURUSD=X", "multiply")}


def calendar(prices: DataFrame, listing: str) -> DataFrame:
    """day, idx (from 0): trading days of the calendar listing. One listing's days are a small table."""
    days = prices.filter(F.col("listing") == listing).select("day").distinct()
    return days.withColumn("idx", F.row_number().over(W.orderBy("day")) - 1)


def windows(detections: DataFrame, days: DataFrame, horizon: int) -> DataFrame:
    """event, detected, start, end: horizon trading days after the first one that follows; none if the calendar ends before.

    Every date between two trading days is named after the second of them, so that detections meet them by equality.
    """
    led = days.withColumn("before", F.coalesce(F.lag("day").over(W.orderBy("day")), F.date_sub("day", 1)))
    led = led.select("idx", F.explode(F.sequence("before", F.date_sub("day", 1))).alias("detected"))
    first = days.agg(F.min("day").alias("first"))  # one row
    each = detections.crossJoin(F.broadcast(first)).withColumn("at", F.greatest("detected", F.date_sub("first", 1))).drop("first")
    after = each.join(led.select(F.col("idx").alias("i"), F.col("detected").alias("at")), "at").drop("at")
    a, b = days.select(F.col("idx").alias("i"), F.col("day").alias("start")), days.select(F.col("idx").alias("j"), F.col("day").alias("end"))
    return after.join(a, "i").join(b, F.col("i") + horizon == F.col("j")).select("event", "detected", "start", "end")


def last_days(days: DataFrame, as_of: str, n: int = PRICED_IN_DAYS) -> DataFrame:
    """day: the last n trading days of a calendar up to as_of."""
    return days.filter(F.col("day") <= F.lit(as_of).cast("date")).orderBy(F.desc("day")).limit(n).select("day")


def as_of(left: DataFrame, rows: DataFrame, key: str, at: str, value: str, name: str, slack: int = SLACK) -> DataFrame:
    """left with name: value of the last row of its key on or before column at, within slack days.

    Each row serves the slack + 1 days that it can answer for, so the match is an equi-join on key and day, not a
    range join; the newest wins by a window over rows that moves with the day.
    """
    served = rows.select(F.col(key).alias("_k"), F.col("day").alias("_d"), F.col(value).alias("_v")).withColumn("_at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(slack)), lambda i: F.date_add("_d", i))))
    last = served.groupBy("_k", "_at").agg(F.max_by("_v", "_d").alias(name))
    return left.join(last, (F.col(key) == F.col("_k")) & (F.col(at) == F.col("_at")), "left").drop("_k", "_at")


def market(listing: Column | str = "listing") -> Column:
    """The market that a listing trades on: by its ending, US without one, an index that of its market. Null if it is
    unknown or a rate of exchange, which has none."""
    c = F.col(listing) if isinstance(listing, str) else listing
    ending = F.substring_index(c, ".", -1)
    index = F.coalesce(*(F.when(c == i, m) for m, i in INDEXES.items()))
    by_ending = F.coalesce(*(F.when(ending == e, m) for e, m in MARKETS.items()))
    return F.when(c.endswith("=X"), None).when(c.startswith("^"), index).when(~F.contains(c, F.lit(".")), "US").otherwise(by_ending)


def market_index(listing: Column | str = "listing") -> Column:
    """The index of the market of a listing; null where `market` is."""
    own = market(listing)
    return F.coalesce(*(F.when(own == m, i) for m, i in INDEXES.items()))


def dollar_rates(quotes: DataFrame) -> DataFrame:
    """currency, day, rate (dollars for one unit) of quotes (listing, day, adj_close) of rates of exchange; quotes that are not above 0 give none."""
    rate = F.coalesce(*(F.when(F.col("listing") == q, 1 / F.col("adj_close") if how == "divide" else F.col("adj_close")) for q, how in RATES.values()))
    currency = F.coalesce(*(F.when(F.col("listing") == q, c) for c, (q, _) in RATES.items()))
    return quotes.filter("adj_close > 0").select(currency.alias("currency"), "day", rate.alias("rate")).filter("currency is not null")


def in_usd(prices: DataFrame, rates: DataFrame) -> DataFrame:
    """prices with usd: adj_close at the rate of the day or the last one within the slack; null without a rate."""
    priced = as_of(prices, rates, "currency", "day", "rate", "fx")
    return priced.withColumn("usd", F.when(F.col("currency") == "USD", F.col("adj_close")).when(F.col("fx") > 0, F.col("adj_close") * F.col("fx")))


def legs(prices: DataFrame, spans: DataFrame, slack: int = SLACK) -> DataFrame:
    """event, listing with entry and exit (day, adj_close, usd): the first close after detection, the last one by the end.

    None where either is more than slack days away or they coincide.
    """
    near = prices.select("listing", "day", F.struct("day", "adj_close", "usd").alias("p"))
    served = lambda ahead: near.withColumn("_at", F.explode(F.transform(F.sequence(F.lit(1 if ahead else 0), F.lit(slack)), lambda i: F.date_sub("day", i) if ahead else F.date_add("day", i))))
    entry = spans.join(served(True), F.col("detected") == F.col("_at")).groupBy("event", "detected", "end", "listing").agg(F.min_by("p", "day").alias("entry"))
    exit_ = spans.join(served(False), F.col("end") == F.col("_at")).groupBy("event", "listing").agg(F.max_by("p", "day").alias("exit"))
    return entry.join(exit_, ["event", "listing"]).filter(F.col("exit.day") > F.col("entry.day"))


def outcomes(found: DataFrame) -> DataFrame:
    """event, listing, entry_day, exit_day, usd_return, local_return, benchmark, abnormal over all listings with both ends."""
    usd = F.when(F.col("entry.usd") > 0, F.col("exit.usd") / F.col("entry.usd") - 1)
    out = found.select("event", "listing", F.col("entry.day").alias("entry_day"), F.col("exit.day").alias("exit_day"), usd.alias("usd_return"), (F.col("exit.adj_close") / F.col("entry.adj_close") - 1).alias("local_return"))
    out = out.filter("usd_return is not null").withColumn("benchmark", F.avg("usd_return").over(W.partitionBy("event")))
    return out.withColumn("abnormal", F.col("usd_return") - F.col("benchmark"))


def sign_adjusted(value: str = "abnormal", exposure: str = "exposure"):  # noqa: ANN201
    """A loser that falls scores positive; no exposure is an error."""
    v, e = F.col(value), F.col(exposure)
    return F.when(e > 0, v).when(e < 0, -v).otherwise(F.raise_error(F.lit("a company without exposure is not exposed")))


def daily_abnormal(priced: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """listing, day, abnormal: close-to-close USD return less the mean of the listings that traded on the day."""
    w = W.partitionBy("listing").orderBy("day")
    r = priced.withColumn("before", F.lag("usd").over(w)).filter("usd <> 0 and before <> 0").select("listing", "day", (F.col("usd") / F.col("before") - 1).alias("r"))
    if first:
        r = r.filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return r.withColumn("abnormal", F.col("r") - F.avg("r").over(W.partitionBy("day"))).select("listing", "day", "abnormal")


def priced_in(abnormal: DataFrame, shares: DataFrame, least: int = PRICED_IN_LEAST, within: DataFrame | None = None) -> DataFrame:
    """key, listing, rho: rank correlation of daily abnormal returns with coverage shares; null for few or constant days.

    within (day) bounds the days, as `last_days` gives them.
    """
    if within is not None:
        abnormal = abnormal.join(F.broadcast(within) if within.count() <= MOST_DAYS else within, "day", "left_semi")
    pairs = abnormal.join(shares.select("key", "day", "share"), "day")
    ranked = pairs.withColumns({"ra": average_rank("abnormal", "key", "listing"), "rs": average_rank("share", "key", "listing")})
    agg = ranked.groupBy("key", "listing").agg(F.corr("ra", "rs").alias("rho"), F.count("*").alias("n"), F.min("abnormal").alias("a0"), F.max("abnormal").alias("a1"), F.min("share").alias("s0"), F.max("share").alias("s1"))
    return agg.select("key", "listing", F.when((F.col("n") >= least) & (F.col("a0") < F.col("a1")) & (F.col("s0") < F.col("s1")), F.col("rho")).alias("rho"))
