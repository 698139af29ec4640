"""Integrity rules: each is a query that returns its violations as severity, rule, file, record, message.

nodes: id, type, kind, query, source, file. edges: src, rel, dst, weight, weight_source, polarity, confidence,
valid_from, valid_to, evidence (array of url, note, accessed, verified), source, file, row_id, trusted, source_order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quakeline.functions.scalars import BACKWARD, FORWARD, MIN_CONFIDENCE, isclose
from quakeline.operators.bitemporal import winners
from quakeline.operators.graph import flow_edges, reachable

# Fixed values of the data model.
ID_PATTERN = r"^[a-z]+/[a-z0-9]+(-[a-z0-9]+)*$"
ENDPOINTS = {
    "DRIVES": (("theme",), ("product", "material")), "REQUIRES": (("product", "material"),) * 2, "PRODUCES": (("company",), ("product", "material")), "SUPPLIES": (("company",),) * 2,
    "SUBSTITUTES": (("product", "material"),) * 2, "COMPETES_WITH": (("company",),) * 2, "SUBSIDIARY_OF": (("company",),) * 2, "EXPOSED_TO": (("company",), ("region",)),
}
BUCKETS = {"revenue": {"minor": 0.05, "meaningful": 0.25, "core": 0.6, "pure": 0.9}, "demand": {"minor": 0.1, "major": 0.4, "dominant": 0.8}}
QUANTITY = {"PRODUCES": "revenue", "SUPPLIES": "revenue", "SUBSIDIARY_OF": "revenue", "DRIVES": "demand", "REQUIRES": "demand"}
SHARE_LIMIT, PATH_HOPS, NOTE_LENGTH = 1 + 1e-9, 3, 200
_KEY = ["src", "rel", "dst"]


def label() -> Column:
    return F.concat_ws(" ", *_KEY)


def problem(df: DataFrame, severity: str, rule: str, record: Column | str, message: Column | str, file: Column | str = "file") -> DataFrame:
    text = message if isinstance(message, Column) else F.lit(message)
    name = F.col(record) if isinstance(record, str) else record
    where = (F.col(file) if file in df.columns else F.lit(None).cast("string")) if isinstance(file, str) else file
    return df.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), where.alias("file"), name.alias("record"), text.alias("message"))


def e1(nodes: DataFrame) -> DataFrame:
    again = nodes.withColumn("n", F.row_number().over(W.partitionBy("source", "id").orderBy("file"))).filter("n > 1")
    bad = nodes.filter(~F.col("id").rlike(ID_PATTERN))
    prefix = nodes.filter(F.col("id").rlike(ID_PATTERN) & (F.substring_index("id", "/", 1) != F.col("type")))
    return problem(again, "error", "E1", "id", "duplicate node id").union(problem(bad, "error", "E1", "id", "id must be type/slug")).union(problem(prefix, "error", "E1", "id", "prefix is not the type"))


def e2(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select("file", label().alias("record"), F.explode(F.array("src", "dst")).alias("end"))
    return problem(ends.join(nodes.select(F.col("id").alias("end")).distinct(), "end", "left_anti"), "error", "E2", "record", F.concat(F.lit("no node "), "end"))


def e3(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    types = nodes.select("id", "type").dropDuplicates(["id"])
    both = edges.join(types.select(F.col("id").alias("src"), F.col("type").alias("st")), "src").join(types.select(F.col("id").alias("dst"), F.col("type").alias("dt")), "dst")
    fits = reduce(lambda a, b: a | b, ((F.col("rel") == r) & F.col("st").isin(*s) & F.col("dt").isin(*d) for r, (s, d) in ENDPOINTS.items()))
    return problem(both.filter(~fits), "error", "E3", label(), F.concat_ws(" ", "rel", F.lit("does not allow"), "st", F.lit("to"), "dt"))


def e4(edges: DataFrame) -> DataFrame:
    out = [problem(edges.filter(~((F.col(c) > 0) & (F.col(c) <= 1))), "error", "E4", label(), F.concat(F.lit(f"{c} is not in (0, 1]: "), c)) for c in ("weight", "confidence")]
    return out[0].union(out[1]).union(problem(edges.filter("polarity not in (1, -1)"), "error", "E4", label(), "polarity is not 1 or -1"))


def e5(edges: DataFrame) -> DataFrame:
    none = edges.filter(F.coalesce(F.size("evidence"), F.lit(0)) <= 0)
    bare = edges.filter(F.exists("evidence", lambda e: (F.coalesce(e["url"], F.lit("")) == "") | e["accessed"].isNull()))
    return problem(none, "error", "E5", label(), "no evidence").union(problem(bare, "error", "E5", label(), "evidence needs url and accessed"))


def e8(edges: DataFrame) -> DataFrame:
    cols = [*_KEY, "source", "valid_from", F.coalesce("valid_to", F.lit("9999-12-31").cast("date")).alias("end"), "row_id"]
    a, b = edges.select(*cols), edges.select(*cols, "file")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*_KEY, "source")]
    pairs = a.alias("a").join(b.alias("b"), reduce(lambda x, y: x & y, same) & (F.col("a.row_id") < F.col("b.row_id")) & (F.col("a.valid_from") < F.col("b.end")) & (F.col("b.valid_from") < F.col("a.end")))
    return problem(pairs.select("b.*"), "error", "E8", label(), "same edge with overlapping valid time").distinct()


def e9(edges: DataFrame) -> DataFrame:
    return problem(edges.filter("valid_to <= valid_from"), "error", "E9", label(), "valid_to must be after valid_from")


def e11(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    signs = edges.filter("rel = 'DRIVES'").groupBy(F.col("src").alias("id")).agg(F.max(F.col("polarity") == 1).alias("up"), F.max(F.col("polarity") == -1).alias("down"))
    both = nodes.filter("kind = 'share_shift'").join(signs, "id", "left").filter(~F.coalesce(F.col("up") & F.col("down"), F.lit(False)))
    return problem(both, "error", "E11", "id", "a share_shift theme needs both signs")


def e13(nodes: DataFrame) -> DataFrame:
    bad = nodes.filter("type = 'theme' and (kind is null or kind not in ('volume', 'share_shift'))")
    return problem(bad, "error", "E13", "id", "theme kind must be volume or share_shift").union(problem(nodes.filter("type <> 'theme' and kind is not null"), "error", "E13", "id", "only themes have a kind"))


def active(edges: DataFrame) -> DataFrame:
    """day, edge: the winning edges on every day on which one becomes valid; sums can grow on these days only."""
    days = edges.select(F.col("valid_from").alias("day")).distinct()
    on = edges.join(days, (F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("day"))))
    return winners(on, ["day", *_KEY])


def _first(df: DataFrame, *keys: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("day"))).filter("_n = 1")


def share_sums(on: DataFrame) -> DataFrame:
    """E6, E7 and W5: shares that add up to more than one, the first day for each node."""
    out = None
    for severity, rule, rel, node in (("error", "E6", "PRODUCES", "src"), ("error", "E7", "REQUIRES", "dst"), ("warning", "W5", "DRIVES", "dst")):
        sums = on.filter(F.col("rel") == rel).groupBy("day", F.col(node).alias("node")).agg(F.sum("weight").alias("total"), F.countDistinct("src").alias("sources"))
        over = _first(sums.filter((F.col("total") > SHARE_LIMIT) & ((F.col("sources") > 1) | F.lit(rule != "W5"))), "node")
        found = problem(over, severity, rule, "node", F.concat(F.lit(f"{rel} weights sum to "), F.format_number("total", 2), F.lit(" on "), "day"))
        out = found if out is None else out.union(found)
    return out


def share_sweep(edges: DataFrame, rel: str, node: str) -> DataFrame:
    """node, day: the first day on which the shares of a single source's edges add up to more than one.

    Every edge adds its weight on valid_from and takes it away on valid_to, so a running sum over the days on which
    anything changes finds it; no day is joined with the edges that are valid on it.
    """
    own = edges.filter(F.col("rel") == rel)
    steps = own.select(F.col(node).alias("node"), F.explode(F.array(F.struct(F.col("valid_from").alias("day"), F.col("weight").alias("w"), F.lit(1).alias("s")), F.struct(F.col("valid_to").alias("day"), (-F.col("weight")).alias("w"), F.lit(0).alias("s")))).alias("x"))
    days = steps.filter("x.day is not null").groupBy("node", F.col("x.day").alias("day")).agg(F.sum("x.w").alias("w"), F.max("x.s").alias("starts"))
    running = days.withColumn("total", F.sum("w").over(W.partitionBy("node").orderBy("day")))
    return running.filter((F.col("starts") == 1) & (F.col("total") > SHARE_LIMIT)).groupBy("node").agg(F.min("day").alias("day"))


def e10(nodes: DataFrame, on: DataFrame) -> DataFrame:
    """A volume theme drives a node that it also reaches from another target by one REQUIRES step or more, on that day."""
    volume = nodes.filter("kind = 'volume'").select(F.col("id").alias("src"))
    drives = on.filter("rel = 'DRIVES'").join(volume, "src", "left_semi").select("day", F.col("src").alias("theme"), F.col("dst").alias("target"))
    needs = on.filter("rel = 'REQUIRES'")
    at = lambda d, n: F.concat_ws("|", d, n)  # noqa: E731  a node on a day
    flow = needs.select(at("day", "src").alias("from_node"), at("day", "dst").alias("to_node"))
    start = drives.select(at("day", "target").alias("shock"), at("day", "target").alias("node")).distinct()
    met = reachable(flow, start).filter("shock <> node")
    a = drives.select("day", "theme", at("day", "target").alias("shock"))
    b = drives.select(F.col("theme").alias("t2"), at("day", "target").alias("node"), F.col("target").alias("reached"))
    twice = met.join(a, "shock").join(b, "node").filter("theme = t2")
    return problem(_first(twice, "theme", "reached"), "error", "E10", "theme", F.concat(F.lit("drives "), "reached", F.lit(" directly and through REQUIRES")))


def e12(on: DataFrame) -> DataFrame:
    forward, backward = F.col("rel").isin(*FORWARD), F.col("rel").isin(*BACKWARD)
    cells = on.filter(forward | backward).select("day", F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("f"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("t"), label().alias("k"))
    many = cells.groupBy("day", "f", "t").agg(F.countDistinct("k").alias("n"), F.max("k").alias("record")).filter("n > 1")
    return problem(_first(many, "f", "t"), "error", "E12", "record", F.concat_ws(" ", F.lit("several edges on the cell"), "f", "t"))


def w1_w2(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    makes = edges.filter("rel = 'PRODUCES'")
    unmade = nodes.filter(F.col("type").isin("product", "material")).join(makes.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    idle = nodes.filter("type = 'company'").join(makes.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    return problem(unmade, "warning", "W1", "id", "no company produces this").union(problem(idle, "warning", "W2", "id", "company produces nothing"))


def w3_w4(nodes: DataFrame, edges: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    start = nodes.filter("type = 'theme'").select(F.lit("all").alias("shock"), F.col("id").alias("node"))
    full = edges if "edge_id" in edges.columns else edges.withColumn("edge_id", label())
    every = reachable(flow_edges(full, float("-inf")), start).select(F.col("node").alias("id"))
    sure = reachable(flow_edges(full, min_confidence), start).select(F.col("node").alias("id"))
    inner = nodes.filter("type not in ('theme', 'region')")
    lost = inner.join(every, "id", "left_anti")
    weak = inner.filter("type = 'company'").join(every, "id", "left_semi").join(sure, "id", "left_anti")
    return problem(lost, "warning", "W3", "id", "no theme reaches this").union(problem(weak, "warning", "W4", "id", "reached through doubtful edges only"))


def w6_w7(edges: DataFrame, today: str) -> DataFrame:
    each = edges.select("file", label().alias("record"), F.explode("evidence").alias("e"))
    late = each.filter(F.col("e.accessed") > F.lit(today).cast("date"))
    return problem(late, "warning", "W6", "record", "evidence accessed in the future").union(problem(each.filter(F.length("e.note") > NOTE_LENGTH), "warning", "W7", "record", "evidence note is long"))


def w8(edges: DataFrame) -> DataFrame:
    fits = F.lit(False)
    for rel, quantity in QUANTITY.items():
        for value in BUCKETS[quantity].values():
            fits = fits | ((F.col("rel") == rel) & isclose(F.col("weight"), F.lit(value)))
    return problem(edges.filter((F.col("weight_source") == "bucket") & F.col("rel").isin(*QUANTITY) & ~fits), "warning", "W8", label(), F.concat(F.lit("no bucket has the weight "), "weight"))


def w9(edges: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """SUPPLIES edges whose demand already flows through products: customer's product, 1 to 3 REQUIRES, supplier's product."""
    makes = edges.filter("rel = 'PRODUCES'").select(F.col("src").alias("company"), F.col("dst").alias("product")).distinct()
    needs = edges.filter("rel = 'REQUIRES'").select(F.col("src").alias("product"), F.col("dst").alias("need")).distinct()
    supplies = edges.filter((F.col("rel") == "SUPPLIES") & (F.col("confidence") >= min_confidence))
    front = supplies.select("src", "dst").distinct().join(makes, F.col("dst") == F.col("company")).select("src", "dst", "product")
    sold = makes.select(F.col("company").alias("src"), F.col("product").alias("need"))
    seen, found = front, None
    for _ in range(PATH_HOPS):
        front = front.join(needs, "product").select("src", "dst", "need").distinct().join(seen.withColumnRenamed("product", "need"), ["src", "dst", "need"], "left_anti")
        hit = front.join(sold, ["src", "need"], "left_semi").select("src", "dst")
        found = hit if found is None else found.union(hit)
        front = front.withColumnRenamed("need", "product")
        seen = seen.unionByName(front)
    return problem(supplies.join(found.distinct(), ["src", "dst"], "left_semi"), "warning", "W9", label(), "products already carry this demand")


def w10(nodes: DataFrame) -> DataFrame:
    return problem(nodes.filter((F.col("type") == "theme") & (F.trim(F.coalesce("query", F.lit(""))) == "")), "warning", "W10", "id", "theme without a query")


def w11(edges: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    own = edges.filter(F.col("rel").isin(*FORWARD, *BACKWARD) & (F.col("confidence") >= min_confidence))
    keys = own.groupBy(*_KEY).agg(F.max(F.exists("evidence", lambda e: F.coalesce(e["verified"], F.lit(False)))).alias("ok"))
    sums = keys.agg(F.count("*").alias("n"), F.count(F.when(~F.coalesce("ok", F.lit(False)), 1)).alias("bad")).filter("bad > 0")
    return problem(sums, "warning", "W11", F.lit("(graph)"), F.concat_ws(" ", "bad", F.lit("of"), "n", F.lit("propagating edges have no verified evidence")))


def validate(nodes: DataFrame, edges: DataFrame, today: str, require_verified: bool = False, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """All problems, each once, errors first."""
    on = active(edges)
    first = nodes.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy("source", "file"))).filter("_n = 1").drop("_n")
    parts = [e1(nodes), e2(nodes, edges), e3(first, edges), e4(edges), e5(edges), e8(edges), e9(edges), e11(first, edges), e13(nodes), share_sums(on), e10(first, on), e12(on), w1_w2(first, edges), w3_w4(first, edges, min_confidence), w6_w7(edges, today), w8(edges), w9(edges, min_confidence), w10(nodes)]
    if require_verified:
        parts.append(w11(edges, min_confidence))
    return reduce(DataFrame.union, parts).distinct().orderBy("severity", "rule", "record")
