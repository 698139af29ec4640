"""A clean graph and one violation of each rule."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from quakeline.functions.scalars import edge_id
from quakeline.operators import rules as R
from quakeline.sources.records import EVIDENCE

D = date(2024, 1, 1)
NODES = [("theme/t", "theme", "volume", "q"), ("product/p", "product", None, None), ("material/m", "material", None, None), ("company/a", "company", None, None), ("company/b", "company", None, None)]
EDGES = [("theme/t", "DRIVES", "product/p", 0.9), ("product/p", "REQUIRES", "material/m", 0.4), ("company/a", "PRODUCES", "product/p", 0.6), ("company/b", "PRODUCES", "material/m", 0.5)]
GOOD = [{"url": "http://x", "note": "n", "accessed": D, "verified": True, "span": None}]


def run(spark, nodes=(), edges=(), **more):
    n = spark.createDataFrame([(*x, "s", "f") for x in [*NODES, *nodes]], "id string, type string, kind string, query string, source string, file string")
    rows = []
    for i, e in enumerate([*EDGES, *edges]):
        base = {"src": e[0], "rel": e[1], "dst": e[2], "weight": e[3], "weight_source": "manual", "polarity": 1, "confidence": 1.0, "valid_from": D, "valid_to": None, "evidence": GOOD, "source": "s", "file": "f", "row_id": f"r{i}", "trusted": False, "source_order": 0}
        rows.append({**base, **(e[4] if len(e) > 4 else {})})
    schema = f"src string, rel string, dst string, weight double, weight_source string, polarity int, confidence double, valid_from date, valid_to date, evidence {EVIDENCE}, source string, file string, row_id string, trusted boolean, source_order int"
    edges_ = spark.createDataFrame(rows, schema).withColumn("edge_id", edge_id())
    return {r.rule for r in R.validate(n, edges_, "2026-01-01", **more).collect()}


def test_clean(spark):
    assert run(spark) == set()


CASES = [
    ("E1", [("product/Bad_id", "product", None, None)], []), ("E2", [], [("company/a", "PRODUCES", "product/none", 0.1)]), ("E3", [], [("company/a", "DRIVES", "product/p", 0.05)]), ("E4", [], [("company/b", "COMPETES_WITH", "company/a", 1.5)]),
    ("E5", [], [("company/b", "COMPETES_WITH", "company/a", 0.5, {"evidence": []})]), ("E6", [], [("company/a", "PRODUCES", "material/m", 0.6)]), ("E8", [], [("company/a", "PRODUCES", "product/p", 0.6)]),
    ("E9", [], [("company/b", "COMPETES_WITH", "company/a", 0.5, {"valid_to": D})]), ("E10", [], [("theme/t", "DRIVES", "material/m", 0.1)]), ("E11", [("theme/s", "theme", "share_shift", "q")], []), ("E13", [("theme/u", "theme", None, "q")], []),
    ("W1", [("product/z", "product", None, None)], []), ("W2", [("company/z", "company", None, None)], []), ("W6", [], [("company/b", "COMPETES_WITH", "company/a", 0.5, {"evidence": [{**GOOD[0], "accessed": date(2027, 1, 1)}]})]),
    ("W7", [], [("company/b", "COMPETES_WITH", "company/a", 0.5, {"evidence": [{**GOOD[0], "note": "x" * 201}]})]), ("W8", [], [("company/b", "SUPPLIES", "company/a", 0.33, {"weight_source": "bucket"})]), ("W9", [], [("company/b", "SUPPLIES", "company/a", 0.3)]),
    ("W10", [("theme/v", "theme", "volume", " ")], []),
]


@pytest.mark.parametrize(("rule", "nodes", "edges"), CASES, ids=[c[0] for c in CASES])
def test_violation(spark, rule, nodes, edges):
    assert rule in run(spark, nodes, edges)


def test_sweep(spark):
    e = spark.createDataFrame([("a", "PRODUCES", "x", 0.6, D, date(2024, 2, 1)), ("a", "PRODUCES", "y", 0.6, date(2024, 2, 1), None), ("a", "PRODUCES", "z", 0.5, date(2024, 3, 1), None)], "src string, rel string, dst string, weight double, valid_from date, valid_to date")
    assert [tuple(r) for r in R.share_sweep(e, "PRODUCES", "src").collect()] == [("a", date(2024, 3, 1))]
    assert F is not None
