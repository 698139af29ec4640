"""Readers of news, price and filing payloads (JSON), flattened without Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIMELINE = "timeline array<struct<series:string,data:array<struct<date:string,value:double,norm:bigint>>>>"
ARTICLES = "articles array<struct<url:string,title:string,domain:string,seendate:string,language:string>>"
CHART = (
    "chart struct<result:array<struct<meta:struct<symbol:string,currency:string,gmtoffset:bigint>,timestamp:array<bigint>,"
    "indicators:struct<quote:array<struct<close:array<double>>>,adjclose:array<struct<adjclose:array<double>>>>>>,error:struct<code:string,description:string>>"
)
FILINGS = "cik string, filings struct<recent:struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,primaryDocument:array<string>>>"
# Currencies against the dollar, and the market index by the ending of a listing.
ANNUAL_FORMS = ("10-K", "20-F", "40-F")


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("file", F.input_file_name())


def news_timeline(spark: SparkSession, path: str) -> DataFrame:
    """file, day, value, norm of every point whose date can be read."""
    points = _json(spark, path, TIMELINE).select("file", F.explode("timeline").alias("t")).select("file", F.explode("t.data").alias("p"))
    return points.select("file", F.try_to_date(F.substring("p.date", 1, 8), "yyyyMMdd").alias("day"), "p.value", "p.norm").filter("day is not null")


def news_volume(points: DataFrame) -> DataFrame:
    """day, matched, norm."""
    return points.select("file", "day", F.col("value").cast("bigint").alias("matched"), "norm")


def news_articles(spark: SparkSession, path: str, most: int = 250) -> DataFrame:
    """Articles of each payload in order, at most as many as the source returns in one."""
    return _json(spark, path, ARTICLES).select("file", F.posexplode(F.slice("articles", 1, most)).alias("n", "a")).select("file", "n", "a.*")


def price_chart(spark: SparkSession, path: str) -> DataFrame:
    """file, listing, day, close, adj_close, currency; days without a close are left out, arrays of unlike lengths give none."""
    r = _json(spark, path, CHART).select("file", F.explode("chart.result").alias("r"))
    close, adj = F.col("r.indicators.quote")[0]["close"], F.col("r.indicators.adjclose")[0]["adjclose"]
    r = r.withColumns({"c": close, "a": adj}).filter((F.size("r.timestamp") == F.size("c")) & (F.size("c") == F.size("a")))
    rows = r.select("file", "r.meta.symbol", "r.meta.currency", "r.meta.gmtoffset", F.explode(F.arrays_zip(F.col("r.timestamp").alias("ts"), F.col("c").alias("c"), F.col("a").alias("a"))).alias("z"))
    day = F.to_date(F.timestamp_seconds(F.col("z")["ts"] + F.coalesce("gmtoffset", F.lit(0))))
    return rows.select("file", F.col("symbol").alias("listing"), day.alias("day"), F.col("z")["c"].alias("close"), F.col("z")["a"].alias("adj_close"), "currency").filter("close is not null and adj_close is not null")


def price_errors(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, CHART).filter("chart.error is not null").select("file", "chart.error.*")


def latest_annual(spark: SparkSession, path: str) -> DataFrame:
    """cik and the first annual filing in order of the payload, which is the latest."""
    zipped = F.arrays_zip(*(F.col(f"filings.recent.{c}").alias(c) for c in ("accessionNumber", "form", "filingDate", "primaryDocument")))
    own = _json(spark, path, FILINGS).withColumn("f", F.filter(zipped, lambda x: x["form"].isin(*ANNUAL_FORMS)))
    return own.filter(F.size("f") > 0).select("cik", F.element_at("f", 1).alias("f")).select("cik", "f.*")


def newest_cached(filings: DataFrame) -> DataFrame:
    """The newest filing of each cik."""
    return filings.groupBy("cik").agg(F.max_by(F.struct(*filings.columns), F.struct("filing_date", "accession")).alias("f")).select("f.*")


def universe(companies: DataFrame, tickers: DataFrame, annual: DataFrame) -> DataFrame:
    """companies (id, ticker) with cik and annual form; who does not file is kept with sec false."""
    named = companies.join(tickers.select(F.upper("ticker").alias("_t"), F.col("cik_str").cast("string").alias("cik")), F.upper("ticker") == F.col("_t"), "left").drop("_t")
    return named.join(annual.select("cik", "form"), "cik", "left").withColumn("sec", F.col("cik").isNotNull())
