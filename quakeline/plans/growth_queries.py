"""Queries of candidates, names, news queries, rulings and markets over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeline.operators import answers as A
from quakeline.operators import documents as D
from quakeline.operators import growth as G
from quakeline.operators import returns as R
from quakeline.sources import binding as B

QUERIES: dict = {}
ORACLE_SQL: dict = {}
CAP = 100


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as filers, parts as the companies they mention, brands as products."""
    part = B.read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    line = B.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("filer"), F.col("l_orderkey").alias("section"), F.col("l_partkey").alias("p_partkey"))
    cik = F.when(F.col("p_size") > 3, F.col("p_partkey"))
    made = F.when(F.col("p_size") > 10, F.array("p_brand", F.lit("no brand"))).otherwise(F.array().cast("array<string>"))
    return line.join(part, "p_partkey").select("filer", "section", F.col("p_name").alias("name"), cik.alias("cik"), F.col("p_name").alias("title"), made.alias("products"), F.lit(0).alias("start"), F.concat(F.lit("p"), "p_partkey").alias("candidate"))


_FOUND = """found AS (SELECT 'p' || p_partkey AS candidate, p_name AS name, CASE WHEN p_size > 3 THEN p_partkey END AS cik, p_size, p_brand, p_type, CASE WHEN p_size > 10 THEN p_brand ELSE '' END AS products,
  count(DISTINCT l_suppkey) AS n_filers, count(*) AS n_mentions FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


@query(f"WITH {_FOUND} SELECT candidate, name, cik, products, n_filers, n_mentions FROM found")
def q_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = B.read(spark, sf_dir, "part").select(F.col("p_brand").alias("id")).distinct()
    found = G.candidates(_mentions(spark, sf_dir), brands)
    return found.select("candidate", "name", "cik", F.array_join("products", ",").alias("products"), "n_filers", "n_mentions")


@query(f"""WITH {_FOUND},
judged AS (SELECT *, CASE WHEN cik IS NULL THEN 'not a filer' WHEN p_size = 20 THEN 'already in the universe' WHEN p_size = 30 THEN 'rejected in review: ' || p_type
  WHEN products = '' THEN 'makes no known product' END AS no, p_size <= 40 AS form FROM found),
ranked AS (SELECT *, sum(CASE WHEN no IS NULL AND form THEN 1 ELSE 0 END) OVER (ORDER BY n_filers DESC, n_mentions DESC, name, candidate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM judged)
SELECT candidate, name, coalesce(no, CASE WHEN upto - CASE WHEN form THEN 1 ELSE 0 END >= {CAP} THEN 'over cap' WHEN NOT form THEN 'no annual report' ELSE 'added' END) AS decision FROM ranked""")
def q_candidate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = B.read(spark, sf_dir, "part").withColumn("cik", F.col("p_partkey"))
    brands = part.select(F.col("p_brand").alias("id")).distinct()
    known, rejected = part.filter("p_size = 20").select("cik"), part.filter("p_size = 30").select("cik", F.col("p_type").alias("reason"))
    forms = part.filter("p_size <= 40").select("cik", F.lit("10-K").alias("form"))
    return G.select_additions(G.candidates(_mentions(spark, sf_dir), brands), known, rejected, forms, CAP)


@query("SELECT s_name || ' Holdings' AS mention, s_suppkey AS id, 0.9::DOUBLE AS score FROM supplier")
def q_names_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.read(spark, sf_dir, "supplier")
    titles = s.select(F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit(" Technologies Group")).alias("title"))
    return D.resolve_names(s.select(F.concat("s_name", F.lit(" Holdings")).alias("mention")), titles)


@query("""SELECT c_custkey AS id, CASE WHEN c_name = c_mktsegment THEN '("' || c_name || '")' ELSE '("' || c_name || '" OR "' || c_mktsegment || '")' END AS query FROM customer""")
def q_company_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.read(spark, sf_dir, "customer")
    aliases = F.array(F.concat("c_name", F.lit(",")), F.lit("A&B"), F.col("c_nationkey").cast("string"), F.lit("12345"), F.concat(F.lit(" "), "c_mktsegment"))
    return c.select(F.col("c_custkey").alias("id"), G.company_query(F.col("c_name"), aliases).alias("query"))


_ITEMS = "items AS (SELECT 'e-' || doc_id AS edge, source AS url, lang AS note_hash, CASE WHEN n_chars < 500 THEN 'seed' WHEN n_chars < 2000 THEN 'llm' WHEN n_chars < 9000 THEN 'xbrl' ELSE 'other' END AS source, lang AS label FROM documents), rulings AS (SELECT DISTINCT 'e-' || doc_id AS edge, source AS url, lang AS note_hash, CASE quality WHEN 1 THEN 'verified' ELSE 'dead-link' END AS ruling FROM documents JOIN labels USING (doc_id))"


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as evidence of edges, their sources as URLs, labels as rulings."""
    docs, edge = B.read(spark, sf_dir, "documents"), F.concat(F.lit("e-"), "doc_id").alias("edge")
    layer = F.when(F.col("n_chars") < 500, "seed").when(F.col("n_chars") < 2000, "llm").when(F.col("n_chars") < 9000, "xbrl").otherwise("other")
    items = docs.select(edge, F.col("source").alias("url"), F.col("lang").alias("note_hash"), layer.alias("source"), F.col("lang").alias("label"))
    ruled = docs.select("doc_id", "source", "lang").join(B.read(spark, sf_dir, "labels"), "doc_id")
    ruling = F.when(F.col("quality") == 1, "verified").otherwise("dead-link")
    return items, ruled.select(edge, F.col("source").alias("url"), F.col("lang").alias("note_hash"), ruling.alias("ruling")).distinct()


@query(f"""WITH {_ITEMS}, unruled AS (SELECT i.* FROM items i ANTI JOIN rulings USING (edge, url, note_hash))
SELECT url, edge, count(*) OVER (PARTITION BY url) AS unruled, CASE source WHEN 'xbrl' THEN 0 WHEN 'seed' THEN 1 WHEN 'llm' THEN 2 ELSE 3 END AS layer FROM unruled""")
def q_unruled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.unruled_documents(*_items(spark, sf_dir)).select("url", "edge", "unruled", "layer")


@query(f"""WITH {_ITEMS} SELECT i.source, count(*) AS items, count(ruling) AS ruled, count(*) FILTER (WHERE ruling = 'verified') AS verified, count(*) FILTER (WHERE ruling <> 'verified') AS failed,
  count(DISTINCT CASE WHEN ruling IS NULL THEN i.url END) AS documents_left FROM items i LEFT JOIN rulings USING (edge, url, note_hash) GROUP BY i.source""")
def q_verification_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.verification_status(*_items(spark, sf_dir))


@query("""SELECT DISTINCT 'product/' || p_name AS product, 'material/' || p_type AS input, bool_or(l_returnflag = 'R' AND l_quantity > 45) AS found FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def q_requires_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = B.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("product/"), "p_name").alias("product"), F.concat(F.lit("material/"), "p_type").alias("input"))
    links = B.read(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_quantity").join(part, "l_partkey")
    return A.requires_recall(links, links.filter("l_returnflag = 'R' and l_quantity > 45"))


@query("""WITH l AS (SELECT s_suppkey AS id, CASE WHEN s_nationkey < 5 THEN s_name WHEN s_nationkey < 10 THEN s_name || '.T' WHEN s_nationkey < 15 THEN s_name || '.PA' WHEN s_nationkey < 18 THEN '^KS11' WHEN s_nationkey < 20 THEN 'EURUSD=X' ELSE s_name || '.DE' END AS listing FROM supplier)
SELECT id, listing, CASE WHEN listing LIKE '^%' THEN '^KS11' WHEN listing LIKE '%=X' THEN NULL WHEN listing LIKE '%.T' THEN '^N225' WHEN listing LIKE '%.PA' THEN '^FCHI' WHEN listing LIKE '%.DE' THEN '^GDAXI' ELSE '^GSPC' END AS market_index FROM l""")
def q_market_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, name = F.col("s_nationkey"), F.col("s_name")
    listing = F.when(n < 5, name).when(n < 10, F.concat(name, F.lit(".T"))).when(n < 15, F.concat(name, F.lit(".PA"))).when(n < 18, "^KS11").when(n < 20, "EURUSD=X").otherwise(F.concat(name, F.lit(".DE")))
    return B.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), listing.alias("listing")).withColumn("market_index", R.market_index())
