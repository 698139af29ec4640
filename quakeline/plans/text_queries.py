"""Document, event and text queries over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeline.operators import documents as D
from quakeline.sources import binding as B

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("SELECT event_type AS kind, count(*) AS jobs, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS tokens FROM events GROUP BY event_type")
def q_json_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("jobs"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("tokens"))


@query("SELECT event_type AS key, date_trunc('hour', ts) AS start, count(*) AS matched FROM events GROUP BY ALL")
def q_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.read(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("key"), F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("matched")).select("key", F.col("w.start").alias("start"), "matched")


@query("""SELECT user_id, count(*) AS sessions, CAST(max(n) AS BIGINT) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY ALL) GROUP BY user_id""")
def q_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.read(spark, sf_dir, "events").groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return e.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("SELECT page_id AS doc_id, rtrim(regexp_extract('Seen at (' || url || ').', 'https?://[^\\s)\\]>`''\"]+'), '.,;:') AS cited FROM pages WHERE regexp_matches(url, '^https?://.')")
def q_citation_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("Seen at ("), "url", F.lit(").")).alias("text"))
    return D.citations(docs).filter("kind = 'url'").select("doc_id", "cited")


@query("SELECT doc_id, regexp_matches(text, '(?i)(\\d+(?:\\.\\d+)?)\\s*(%|percent|per cent)') AS has_share, length(text) AS size FROM documents")
def q_share_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(D.STATED_SHARE).alias("has_share"), F.length("text").cast("bigint").alias("size"))


@query()
def q_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "pages").select("page_id", D.plain_text(F.col("html")).alias("text"))


# no text has items, and none is longer than a chunk
@query("SELECT doc_id, 'part-1' AS name, 0 AS start, CAST(length(text) AS INTEGER) AS \"end\", true AS fallback FROM documents WHERE length(text) > 0")
def q_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.read(spark, sf_dir, "documents").select("doc_id", "text", F.lit("10-K").alias("form"))
    return D.sections(docs)


# quotes stand anywhere up to the end of a text, with other case and white space; a third of them are of no text
_QUOTES = """SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'not ' || doc_id ELSE '' END || replace(lower(substring(text, CAST(1 + doc_id * 7919 % greatest(length(text) - 50, 1) AS INTEGER), 50)), ' ', '  ') AS quote FROM documents"""


@query(f"""SELECT doc_id, CAST(CASE WHEN m <> '' THEN length(regexp_split_to_array(text, p, 'i')[1]) END AS INTEGER) AS start, CAST(CASE WHEN m <> '' THEN length(regexp_split_to_array(text, p, 'i')[1]) + length(m) END AS INTEGER) AS "end" FROM (
  SELECT *, regexp_extract(text, p, 0, 'i') AS m FROM (SELECT *, array_to_string(list_transform(list_filter(regexp_split_to_array(quote, '\\s+'), lambda x: x <> ''), lambda x: regexp_escape(x)), '\\s+') AS p FROM ({_QUOTES})))""")
def q_quote_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit(1) + F.col("doc_id") * 7919 % F.greatest(F.length("text") - 50, F.lit(1))
    quote = F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("not "), "doc_id")).otherwise(""), F.replace(F.lower(F.substring(F.col("text"), at.cast("int"), F.lit(50))), F.lit(" "), F.lit("  ")))
    docs = B.read(spark, sf_dir, "documents").withColumn("quote", quote)
    return docs.select("doc_id", D.locate_quote("text", "quote").alias("at")).select("doc_id", "at.start", "at.end")


# searched for is the end of the name of every supplier whose key is divisible by 20
@query("""SELECT q.s_suppkey AS query, s.s_suppkey AS id, s.s_name AS label, 0.6 + 0.4 * length(right(q.s_name, 5)) / length(s.s_name) AS score
  FROM supplier q JOIN supplier s ON contains(lower(s.s_name), lower(right(q.s_name, 5))) WHERE q.s_suppkey % 20 = 0""")
def q_search_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.read(spark, sf_dir, "supplier")
    needles = s.filter("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("query"), F.right("s_name", F.lit(5)).alias("needle"))
    both = needles.join(s, F.contains(F.lower("s_name"), F.lower("needle")))
    return both.select("query", F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), D.name_score(F.col("needle"), F.col("s_name")).alias("score"))


@query()
def q_search_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.read(spark, sf_dir, "supplier")
    needles = s.filter("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("query"), F.concat(F.lit("suplier "), F.right("s_name", F.lit(5))).alias("needle"))
    return D.searches(s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), F.col("s_name").alias("name")), needles)


@query("SELECT n_name AS mention, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM nation")
def q_region_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "nation").select(F.col("n_name").alias("mention"), F.regexp_replace(D.region_id(F.col("n_name"), F.col("n_name")), "^region/", "").alias("slug"))


@query("SELECT l_returnflag AS source, count(*) AS items, count(*) FILTER (WHERE l_linestatus = 'O') AS verified, round(avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem GROUP BY l_returnflag")
def q_verification_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = B.read(spark, sf_dir, "lineitem").withColumn("correct", F.col("l_linestatus") == "O")
    return D.precision(line, "l_returnflag").join(line.groupBy("l_returnflag").agg(F.count(F.when(F.col("correct"), 1)).alias("verified")), "l_returnflag").select(F.col("l_returnflag").alias("source"), F.col("n").alias("items"), "verified", F.round("precision", 6).alias("share"))
