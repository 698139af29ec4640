"""What users ask of the graph, each as one table: who is exposed and why, what a link rests on, what a company is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quakeline.functions.scalars import MIN_CONFIDENCE
from quakeline.operators import attention as A
from quakeline.operators import graph as G
from quakeline.operators.scratch import stored

#: Groups of a company's profile: relation, the end on which the company stands, name of the group.
GROUPS = (
    ("PRODUCES", "src", "mix"), ("SUPPLIES", "src", "customers"), ("SUPPLIES", "dst", "suppliers"), ("SUBSIDIARY_OF", "src", "parents"), ("SUBSIDIARY_OF", "dst", "subsidiaries"), ("EXPOSED_TO", "src", "regions"),
)


def _listed(paths: DataFrame, *keys: str) -> DataFrame:
    """keys, paths: the paths of each key, the strongest first. A key has k paths at most."""
    fields = ("place", "path", "edge_ids", "contribution", "confidence", "min_confidence", "guessed")
    return paths.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("paths"))


def find_exposed(
    flow: DataFrame, start: DataFrame, shares: DataFrame, nodes: DataFrame | None = None, hops: int = G.HOPS, k: int = 3, limit: int | None = 20, hide_obvious: bool = False, most: float = 0.8, few: int = 3
) -> DataFrame:
    """The exposed companies of every shock: shock, place, node, (label, ticker,) exposure, hops, share, percentile, novelty, obvious,
    guessed, path_confidence, weakest_confidence, paths.

    Percentiles are taken over all exposed companies of the shock, before obvious ones are hidden and the first `limit`
    by size of exposure are kept. shares: key, share. nodes: node, label, ticker.
    """
    found = A.with_percentile(G.company_exposures(flow, start, hops), shares)
    found = found.withColumns({"novelty": A.novelty(), "obvious": A.obvious(most=most, few=few)})
    if hide_obvious:
        found = found.filter(~F.col("obvious"))
    found = found.withColumn("place", F.row_number().over(W.partitionBy("shock").orderBy("rank")))
    if limit is not None:
        found = found.filter(F.col("place") <= limit)
    if limit is not None:  # few rows, so that paths are looked for to these only
        found = stored(found)
    wanted = found.select("shock", "node") if limit is not None else None
    best = _listed(G.top_paths(flow, start, k, hops, wanted), "shock", "node")
    found = found.join(best, ["shock", "node"], "left")
    top = F.col("paths")[0]
    if nodes is not None:
        found = found.join(nodes.select("node", "label", "ticker"), "node", "left")
    named = ["label", "ticker"] if nodes is not None else []
    return found.select(
        "shock", "place", "node", *named, "exposure", "hops", "share", "percentile", "novelty", "obvious", F.coalesce(top["guessed"], F.lit(0)).alias("guessed"), F.coalesce(top["confidence"], F.lit(0.0)).alias("path_confidence"),
        F.coalesce(top["min_confidence"], F.lit(0.0)).alias("weakest_confidence"), "paths",
    )


def explain_links(flow: DataFrame, pairs: DataFrame, k: int = 3, hops: int = G.HOPS) -> DataFrame:
    """from_node, to_node, place, path, edge_ids, contribution, confidence, min_confidence, guessed, route: the k strongest
    simple paths of each pair (from_node, to_node), whatever their types. All pairs go through one plan."""
    wanted = pairs.select(F.col("from_node").alias("shock"), F.col("to_node").alias("node")).distinct()
    start = wanted.select("shock", F.col("shock").alias("node"), F.lit(1.0).alias("x")).distinct()
    found = G.simple_paths(flow, start, hops).join(wanted, ["shock", "node"], "left_semi")
    return G.strongest(found, k).withColumnsRenamed({"shock": "from_node", "node": "to_node"})


def edge_evidence(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """edges with items: evidence (edge_id, position, url, note, accessed, verified) in order of position; none is an empty list.

    An edge's items are one value of the answer and are gathered as one.
    """
    item = F.struct("position", "url", "note", "accessed", "verified")
    items = evidence.groupBy("edge_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    joined = edges.join(items, "edge_id", "left")
    empty = F.array().cast(joined.schema["items"].dataType)
    return joined.withColumn("items", F.coalesce("items", empty))


def neighbours(edges: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """company, group, place, other, weight, edge_id, weight_source, confidence, propagates: all neighbours of all companies
    in the groups of a profile, the heaviest first. An edge is read once, however many groups it belongs to."""
    side = lambda rel, end, name: F.when(F.col("rel") == rel, F.struct(F.col(end).alias("company"), F.lit(name).alias("group"), F.col("dst" if end == "src" else "src").alias("other")))
    each = edges.withColumn("x", F.explode(F.array_compact(F.array(*(side(*g) for g in GROUPS))))).filter(F.col("x.company").startswith("company/"))
    order = W.partitionBy("company", "group").orderBy(F.desc(F.round("weight", 12)), "edge_id")
    each = each.select("x.*", "weight", "edge_id", "weight_source", "confidence", (F.col("confidence") >= min_confidence).alias("propagates"))
    return each.withColumn("place", F.row_number().over(order))


def profile(edges: DataFrame, companies: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """company, products, mapped_share (what propagates), guessed, and the number of neighbours in each other group; all companies of `companies` (node)."""
    n = neighbours(edges, min_confidence)
    mix = F.col("group") == "mix"
    counts = [F.count(F.when(F.col("group") == g, 1)).alias(g) for g in dict.fromkeys(g for _, _, g in GROUPS) if g != "mix"]
    sums = n.groupBy("company").agg(
        F.count(F.when(mix, 1)).alias("products"), F.sum(F.when(mix & F.col("propagates"), F.col("weight")).otherwise(0.0)).alias("mapped_share"), F.count(F.when(mix & (F.col("weight_source") == "bucket"), 1)).alias("guessed"), *counts
    )
    return companies.select(F.col("node").alias("company")).distinct().join(sums, "company", "left").fillna(0)


def profile_themes(flow: DataFrame, start: DataFrame, hops: int = G.HOPS) -> DataFrame:
    """company, theme, exposure, rank, of, place, route: all themes that reach each company, the largest exposure first, with the strongest path."""
    found = G.company_exposures(flow, start, hops).withColumn("of", F.count("*").over(W.partitionBy("shock")))
    best = G.top_paths(flow, start, 1, hops).select("shock", "node", "route")
    order = W.partitionBy("node").orderBy(F.desc(F.round(F.abs("exposure"), 12)), "shock")
    return found.join(best, ["shock", "node"], "left").select(F.col("node").alias("company"), F.col("shock").alias("theme"), "exposure", "rank", "of", F.row_number().over(order).alias("place"), "route")


def ghost_edges(edges: DataFrame, shown: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """shock, edge_id, src, dst, weight, confidence: edges of demand that are too doubtful to propagate and end at two shown nodes.

    shown: shock, node of the nodes in a flow view.
    """
    doubtful = edges.filter((F.col("confidence") < min_confidence) & F.col("rel").isin(*G.FORWARD, *G.BACKWARD))
    at = lambda end: shown.select("shock", F.col("node").alias(end)).distinct()
    return doubtful.join(at("src"), "src").join(at("dst"), ["shock", "dst"]).select("shock", "edge_id", "src", "dst", "weight", "confidence")
