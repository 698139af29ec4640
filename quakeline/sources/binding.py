"""The engine's tables over the TPC-H-like test tables: graph, versions, coverage, prices; and the same in SQL.

Weights are shares that sum to one where the rules demand it; confidence, sign and kind follow from fixed arithmetic
on keys, so that the SQL gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeline.functions.scalars import edge_id


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, rel, dst, weight, weight_source, polarity, confidence, edge_id."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("product/"), "p_brand").alias("brand"), F.concat(F.lit("material/"), "p_type").alias("type"), (F.col("p_size") <= 25).alias("small"))
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("v")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    own = line.groupBy("l_suppkey", F.when(F.col("small"), F.col("brand")).otherwise(F.col("type")).alias("dst")).agg(F.sum("v").alias("v"))
    supp = own.groupBy("l_suppkey").agg(F.sum("v").alias("t"))
    produces = own.join(supp, "l_suppkey").select(F.concat(F.lit("company/"), "l_suppkey").alias("src"), F.lit("PRODUCES").alias("rel"), "dst", (F.col("v") / F.col("t")).alias("weight"))
    need = line.groupBy("brand", "type").agg(F.sum("v").alias("v"))
    kind = need.groupBy("type").agg(F.sum("v").alias("t"))
    requires = need.join(kind, "type").select(F.col("brand").alias("src"), F.lit("REQUIRES").alias("rel"), F.col("type").alias("dst"), (F.col("v") / F.col("t")).alias("weight"))
    buyers = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    drive = line.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("c_mktsegment", "brand").agg(F.sum("v").alias("v"))
    total = drive.groupBy("brand").agg(F.sum("v").alias("t"))
    drives = drive.join(total, "brand").select(F.concat(F.lit("theme/"), "c_mktsegment").alias("src"), F.lit("DRIVES").alias("rel"), F.col("brand").alias("dst"), (F.col("v") / F.col("t")).alias("weight"))
    n = F.length("src") * 3 + F.length("dst") + F.ascii(F.substring("dst", -1, 1)) + F.ascii(F.substring("src", -1, 1))
    edges = produces.unionByName(requires).unionByName(drives).withColumn("n", n)
    return edges.select(
        "src", "rel", "dst", "weight", F.when(F.col("n") % 3 == 0, "bucket").otherwise("filing").alias("weight_source"),
        F.when((F.col("src") == "theme/MACHINERY") & (F.col("n") % 2 == 0), -1).otherwise(1).alias("polarity"), ((3 + F.col("n") % 8) / 10).alias("confidence"), edge_id().alias("edge_id"),
    )


GRAPH_SQL = """
line AS (SELECT l_orderkey, l_suppkey, l_extendedprice AS v, 'product/' || p_brand AS brand, 'material/' || p_type AS type, p_size <= 25 AS small FROM lineitem JOIN part ON l_partkey = p_partkey),
own AS (SELECT l_suppkey, CASE WHEN small THEN brand ELSE type END AS dst, sum(v) AS v FROM line GROUP BY ALL),
need AS (SELECT brand, type, sum(v) AS v FROM line GROUP BY ALL),
drive AS (SELECT c_mktsegment, brand, sum(v) AS v FROM line JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
raw_edges AS (
  SELECT 'company/' || l_suppkey AS src, 'PRODUCES' AS rel, dst, v / sum(v) OVER (PARTITION BY l_suppkey) AS weight FROM own
  UNION ALL SELECT brand, 'REQUIRES', type, v / sum(v) OVER (PARTITION BY type) FROM need
  UNION ALL SELECT 'theme/' || c_mktsegment, 'DRIVES', brand, v / sum(v) OVER (PARTITION BY brand) FROM drive),
numbered AS (SELECT *, length(src) * 3 + length(dst) + ascii(right(dst, 1)) + ascii(right(src, 1)) AS n FROM raw_edges),
edges AS (SELECT src, rel, dst, weight, CASE WHEN n % 3 = 0 THEN 'bucket' ELSE 'filing' END AS weight_source,
  CASE WHEN src = 'theme/MACHINERY' AND n % 2 = 0 THEN -1 ELSE 1 END AS polarity, (3 + n % 8) / 10.0 AS confidence,
  'e-' || left(sha256(src || '|' || rel || '|' || dst), 10) AS edge_id FROM numbered),
flow AS (SELECT CASE WHEN rel = 'PRODUCES' THEN dst ELSE src END AS f, CASE WHEN rel = 'PRODUCES' THEN src ELSE dst END AS t,
  weight * polarity AS w, edge_id, weight, confidence, weight_source FROM edges WHERE confidence >= 0.5),
themes AS (SELECT DISTINCT src AS shock FROM edges WHERE rel = 'DRIVES'),
h1 AS (SELECT shock, t AS node, sum(w) AS x FROM themes JOIN flow ON f = shock GROUP BY ALL),
h2 AS (SELECT shock, t AS node, sum(x * w) AS x FROM h1 JOIN flow ON f = node GROUP BY ALL),
h3 AS (SELECT shock, t AS node, sum(x * w) AS x FROM h2 JOIN flow ON f = node GROUP BY ALL),
h4 AS (SELECT shock, t AS node, sum(x * w) AS x FROM h3 JOIN flow ON f = node GROUP BY ALL),
walked AS (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3 UNION ALL SELECT *, 4 FROM h4),
exposed AS (SELECT shock, node, sum(x) AS exposure, min(hop) AS hops FROM walked GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY shock ORDER BY abs(exposure) DESC, node) AS rank FROM exposed WHERE node LIKE 'company/%' AND abs(exposure) > 1e-12)
"""


def theme_shocks(spark: SparkSession, sf_dir: str, direction: str = "up") -> DataFrame:
    from quakeline.operators.graph import shocks

    themes = read(spark, sf_dir, "customer").select(F.concat(F.lit("theme/"), "c_mktsegment").alias("node")).distinct()
    return shocks(themes, direction=direction)


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, key, day, matched, norm, tone, query_hash, recorded_at: order priorities as themes over order days."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("day"), "o_totalprice")
    daily = orders.groupBy("day").agg(F.count("*").alias("norm"))
    own = orders.groupBy("key", "day").agg(F.count("*").alias("matched"), F.avg("o_totalprice").alias("tone"))
    return own.join(daily, "day").select(F.lit("theme").alias("kind"), "key", "day", "matched", "norm", (F.col("tone") / -100000.0).alias("tone"), F.lit("q1").alias("query_hash"), F.col("day").cast("timestamp_ntz").alias("recorded_at"))


COVERAGE_SQL = """
ord AS (SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders),
coverage AS (SELECT key, day, count(*) AS matched, any_value(norm) AS norm, avg(o_totalprice) / -100000.0 AS tone FROM ord JOIN (SELECT day, count(*) AS norm FROM ord GROUP BY day) USING (day) GROUP BY key, day)
"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage in two recorded versions: nation of the supplier as key, lineitem by ship day; odd orders came later."""
    supp = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("nation/"), "s_nationkey").alias("key"))
    line = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", F.to_date("l_shipdate").alias("day")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    own = line.groupBy("key", "day", (F.col("l_orderkey") % 2).alias("v")).agg(F.count("*").alias("matched"), F.max("l_orderkey").alias("row_id"))
    return own.select("key", "day", "matched", (F.col("matched") + 10).alias("norm"), F.when(F.col("row_id") % 7 == 0, "old").otherwise("new").alias("query_hash"), F.date_add("day", (F.col("v") * 30).cast("int")).alias("recorded_on"), "row_id")


VERSIONS_SQL = """
versions AS (SELECT key, day, matched, matched + 10 AS norm, CASE WHEN row_id % 7 = 0 THEN 'old' ELSE 'new' END AS query_hash, day + CAST(v * 30 AS INTEGER) AS recorded_on, row_id FROM (
  SELECT 'nation/' || s_nationkey AS key, CAST(l_shipdate AS DATE) AS day, l_orderkey % 2 AS v, count(*) AS matched, max(l_orderkey) AS row_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL))
"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """listing, day, close, adj_close, currency: brands by ship day."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("listing"))
    line = read(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("day"), "l_extendedprice", "l_quantity", "l_discount").join(part, F.col("l_partkey") == F.col("p_partkey"))
    own = line.groupBy("listing", "day").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), F.avg("l_discount").alias("d"))
    last = F.ascii(F.substring("listing", -1, 1)) % 3
    return own.select("listing", "day", "close", (F.col("close") * (1 - F.col("d"))).alias("adj_close"), F.when(last == 0, "USD").when(last == 1, "JPY").otherwise("EUR").alias("currency"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """currency, day, rate (USD for one unit): a fixed function of the day, with gaps."""
    days = prices(spark, sf_dir).select("day").distinct().filter(F.dayofweek("day") > 1)
    wave = F.pmod(F.unix_date("day"), F.lit(97))
    return days.select(F.explode(F.array(F.struct(F.lit("JPY").alias("currency"), (0.008 + wave / 100000).alias("rate")), F.struct(F.lit("EUR").alias("currency"), (1.05 + wave / 1000).alias("rate")))).alias("x"), "day").select("x.currency", "day", "x.rate")


PRICES_SQL = """
prices AS (SELECT listing, day, close, close * (1 - d) AS adj_close, CASE ascii(right(listing, 1)) % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'JPY' ELSE 'EUR' END AS currency FROM (
  SELECT p_brand AS listing, CAST(l_shipdate AS DATE) AS day, avg(l_extendedprice / l_quantity) AS close, avg(l_discount) AS d FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)),
rates AS (SELECT currency, day, CASE currency WHEN 'JPY' THEN 0.008 + wave / 100000 ELSE 1.05 + wave / 1000 END AS rate FROM (SELECT DISTINCT day, CAST((day - DATE '1970-01-01') % 97 AS DOUBLE) AS wave FROM prices WHERE dayofweek(day) > 0), (VALUES ('JPY'), ('EUR')) c(currency)),
usd AS (SELECT p.*, CASE WHEN p.currency = 'USD' THEN 1.0 WHEN p.day - r.day <= 5 THEN r.rate END AS fx FROM prices p ASOF LEFT JOIN rates r ON p.currency = r.currency AND p.day >= r.day)
"""
