"""Version, precedence and rule queries over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeline.operators import bitemporal as T
from quakeline.operators import rules as R
from quakeline.sources import binding as B

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = "WITH " + _FACTS_SQL.strip() + "\n" + sql
        return f

    return register


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of several sources and days: supplier and part of each line, versioned by the order's date."""
    line, orders = B.read(spark, sf_dir, "lineitem"), B.read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    own = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", (F.col("l_partkey") % 20).alias("p"), "day").agg(F.min("l_orderkey").alias("k"), F.avg("l_discount").alias("w"))
    return own.select(
        F.concat(F.lit("company/"), "l_suppkey").alias("src"), F.lit("PRODUCES").alias("rel"), F.concat(F.lit("product/"), "p").alias("dst"), (F.col("w") + 0.01).alias("weight"), F.when(F.col("k") % 3 == 0, "bucket").otherwise("filing").alias("weight_source"),
        F.lit(1).alias("polarity"), ((F.col("k") % 10 + 1) / 10).alias("confidence"), F.col("day").alias("valid_from"), F.when(F.col("k") % 4 == 0, F.date_add("day", 400)).alias("valid_to"),
        (F.col("k") % 5).cast("int").alias("source_order"), F.concat(F.lit("s"), F.col("k") % 5).alias("source"), (F.col("k") % 7 == 0).alias("trusted"), F.concat_ws("-", "k", "l_suppkey", "p").alias("row_id"),
        F.col("day").cast("timestamp").alias("recorded_at"), F.when(F.col("k") % 6 == 0, F.date_add("day", 300).cast("timestamp")).alias("superseded_at"), F.lit("f").alias("file"),
    )


_FACTS_SQL = """
facts AS (SELECT 'company/' || l_suppkey AS src, 'PRODUCES' AS rel, 'product/' || p AS dst, w + 0.01 AS weight, CASE WHEN k % 3 = 0 THEN 'bucket' ELSE 'filing' END AS weight_source, (k % 10 + 1) / 10 AS confidence,
  day AS valid_from, CASE WHEN k % 4 = 0 THEN day + 400 END AS valid_to, CAST(k % 5 AS INTEGER) AS source_order, 's' || (k % 5) AS source, k % 7 = 0 AS trusted, k || '-' || l_suppkey || '-' || p AS row_id,
  day AS recorded_at, CASE WHEN k % 6 = 0 THEN day + 300 END AS superseded_at
  FROM (SELECT l_suppkey, l_partkey % 20 AS p, CAST(o_orderdate AS DATE) AS day, min(l_orderkey) AS k, avg(l_discount) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)),
classed AS (SELECT *, CASE WHEN trusted THEN 0 ELSE 2 END + CASE WHEN weight_source = 'bucket' THEN 1 ELSE 0 END AS cls FROM facts)
"""
_DAY = "DATE '1999-12-31'"


def _winner_sql(where: str) -> str:
    return f""", best AS (SELECT *, min(cls) OVER (PARTITION BY src, rel, dst) AS m FROM classed WHERE {where}),
near AS (SELECT *, max(valid_from) OVER (PARTITION BY src, rel, dst) AS newest FROM best WHERE cls = m),
won AS (SELECT *, row_number() OVER (PARTITION BY src, rel, dst ORDER BY source_order, valid_from DESC, row_id DESC) AS n FROM near WHERE newest - valid_from <= 90)
SELECT src, dst, row_id, round(weight, 6) AS weight, valid_from FROM won WHERE n = 1"""


@query(_winner_sql("true"))
def q_consolidate_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.winners(facts(spark, sf_dir), ["src", "rel", "dst"]).select("src", "dst", "row_id", F.round("weight", 6).alias("weight"), "valid_from")


@query(_winner_sql(f"recorded_at < {_DAY} + 1 AND (superseded_at IS NULL OR superseded_at >= {_DAY} + 1) AND valid_from <= {_DAY} AND (valid_to IS NULL OR valid_to > {_DAY})"))
def q_snapshot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.snapshot(facts(spark, sf_dir), "1999-12-31").select("src", "dst", "row_id", F.round("weight", 6).alias("weight"), "valid_from")


@query(_winner_sql(f"recorded_at < DATE '1998-06-30' + 1 AND (superseded_at IS NULL OR superseded_at >= DATE '1998-06-30' + 1) AND valid_from <= {_DAY} AND (valid_to IS NULL OR valid_to > {_DAY})"))
def q_snapshot_known_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.snapshot(facts(spark, sf_dir), "1999-12-31", "1998-06-30").select("src", "dst", "row_id", F.round("weight", 6).alias("weight"), "valid_from")


@query()
def q_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).select("src", "rel", "dst", "trusted", "weight_source", "valid_from", "source_order", "row_id")
    return T.precedence(rows, ["src", "rel", "dst"]).select("src", "dst", "row_id", "rank_in_key")


@query("""SELECT count(*) FILTER (WHERE n.c_custkey IS NOT NULL AND h2 IS DISTINCT FROM h1) AS inserted, count(*) FILTER (WHERE o.c_custkey IS NOT NULL AND h2 IS DISTINCT FROM h1) AS superseded, count(*) FILTER (WHERE h1 = h2) AS unchanged
FROM (SELECT c_custkey, c_name || c_mktsegment AS h1 FROM customer WHERE c_custkey % 10 <> 3) o FULL JOIN (SELECT c_custkey, c_name || CASE WHEN c_custkey % 7 = 0 THEN 'X' ELSE c_mktsegment END AS h2 FROM customer WHERE c_custkey % 11 <> 5) n USING (c_custkey)""")
def q_scd2_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.read(spark, sf_dir, "customer")
    old = c.filter("c_custkey % 10 <> 3").select("c_custkey", F.concat("c_name", "c_mktsegment").alias("hash"))
    new = c.filter("c_custkey % 11 <> 5").select("c_custkey", F.concat("c_name", F.when(F.col("c_custkey") % 7 == 0, "X").otherwise(F.col("c_mktsegment"))).alias("hash"))
    return T.version_diff(old, new, "c_custkey").agg(*(F.count(F.when(F.col(x), 1)).alias(x) for x in ("inserted", "superseded", "unchanged")))


@query(""", steps AS (SELECT src, valid_from AS day, weight AS w, 1 AS s FROM facts UNION ALL SELECT src, valid_to, -weight, 0 FROM facts WHERE valid_to IS NOT NULL),
days AS (SELECT src, day, sum(w) AS w, max(s) AS s FROM steps GROUP BY ALL), running AS (SELECT *, sum(w) OVER (PARTITION BY src ORDER BY day) AS total FROM days)
SELECT src AS record, min(day) AS day FROM running WHERE s = 1 AND total > 1 + 1e-9 GROUP BY src""")
def q_rule_share_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.share_sweep(facts(spark, sf_dir), "PRODUCES", "src").select(F.col("node").alias("record"), "day")


@query("SELECT DISTINCT b.src || ' PRODUCES ' || b.dst AS record FROM facts a JOIN facts b ON a.src = b.src AND a.dst = b.dst AND a.source = b.source AND a.row_id < b.row_id AND a.valid_from < coalesce(b.valid_to, DATE '9999-12-31') AND b.valid_from < coalesce(a.valid_to, DATE '9999-12-31')")
def q_rule_e8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.e8(facts(spark, sf_dir)).select("record").distinct()


@query("SELECT 'W8' AS rule, count(*) AS n FROM facts WHERE weight_source = 'bucket' AND NOT list_contains([abs(weight - x) <= 1e-9 * greatest(weight, x) FOR x IN [0.05, 0.25, 0.6, 0.9]], true)")
def q_rule_w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.w8(facts(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT rule, count(*) AS n FROM (SELECT CASE WHEN p_size <= 25 THEN 'W1' END AS rule FROM part WHERE p_partkey % 20 >= 0 AND p_partkey NOT IN (SELECT DISTINCT p_ FROM (SELECT CAST(replace(dst, 'product/', '') AS BIGINT) AS p_ FROM facts)) UNION ALL SELECT 'W2' FROM customer WHERE 'company/' || c_custkey NOT IN (SELECT src FROM facts)) WHERE rule IS NOT NULL GROUP BY rule")
def q_rule_w1_w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = B.read(spark, sf_dir, "part").filter("p_size <= 25").select(F.concat(F.lit("product/"), "p_partkey").alias("id"), F.lit("product").alias("type"))
    firms = B.read(spark, sf_dir, "customer").select(F.concat(F.lit("company/"), "c_custkey").alias("id"), F.lit("company").alias("type"))
    return R.w1_w2(parts.union(firms).withColumn("file", F.lit("f")), facts(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("n"))
