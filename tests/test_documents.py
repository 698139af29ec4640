"""XBRL, sections, names, payloads, records and streaming."""

import json
import random
import time
from datetime import date
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeline.operators import documents as D
from quakeline.operators import xbrl as X
from quakeline.sources import payloads as P
from quakeline.sources import records
from quakeline.streaming import coverage as C

INSTANCE = """<xbrli:xbrl xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:xbrldi="http://xbrl.org/2006/xbrldi" xmlns:us-gaap="http://fasb.org/us-gaap" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">
<xbrli:unit id="usd"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit>{contexts}{facts}</xbrli:xbrl>"""


def instance(lines, start="2023-02-01", end="2024-01-31"):
    contexts, facts = [], []
    for i, (dims, value) in enumerate(lines):
        members = "".join(f'<xbrldi:explicitMember dimension="{a}">{m}</xbrldi:explicitMember>' for a, m in dims)
        contexts.append(f'<xbrli:context id="c{i}"><xbrli:entity><xbrli:segment>{members}</xbrli:segment></xbrli:entity><xbrli:period><xbrli:startDate>{start}</xbrli:startDate><xbrli:endDate>{end}</xbrli:endDate></xbrli:period></xbrli:context>')
        facts.append(f'<us-gaap:Revenues contextRef="c{i}" unitRef="usd">{value}</us-gaap:Revenues>')
    return INSTANCE.format(contexts="".join(contexts), facts="".join(facts)).encode()


def test_revenue(spark):
    axis = "us-gaap:StatementBusinessSegmentsAxis"
    parts = {"own:Farm": 257.5, "own:Garden": 162.5, "own:Forest": 80.0, "own:Rental": 140.0}
    lines = [((), 640), *((((axis, m),), v) for m, v in parts.items()), (((axis, "own:Outdoors"),), 242.5), (((axis, "own:Farm"), ("srt:StatementGeographicalAxis", "country:PT")), 31)]
    found = X.facts(spark.createDataFrame([("f", bytearray(instance(lines)))], "filing string, content binary"))
    totals = X.revenue_totals(found)
    assert [(r.total, r.start, r.end, r.currency) for r in totals.collect()] == [(640.0, date(2023, 2, 1), date(2024, 1, 31), "USD")]
    got = X.breakdowns(X.axis_values(found, totals)).collect()
    assert {r.member: r.share for r in got} == {m: pytest.approx(v / 640) for m, v in parts.items()} and all(r.complete and r.kind == "segment" for r in got)


def test_lines_without_aggregates_against_all_subsets():
    """An aggregate goes if other lines add up to it; else the largest set that adds up stays."""
    rng = random.Random(12)
    for _ in range(200):
        parts = {f"{'own' if rng.random() < 0.6 else 'us-gaap'}:{chr(97 + i)}": float(rng.randint(5, 60)) for i in range(rng.randint(2, 6))}
        lines, total = dict(parts), sum(parts.values())
        if len(parts) > 2 and rng.random() < 0.7:
            lines["us-gaap:Sum"] = sum(list(parts.values())[:2])
        if rng.random() < 0.4:
            lines["own:Noise"] = 1000.0 + rng.random()
        kept, dropped = X.partition_lines(lines, total)
        assert set(kept) | set(dropped) == set(lines) and not set(kept) & set(dropped) and all(kept[m] == lines[m] for m in kept)
        sets = [c for k in range(2, len(lines) + 1) for c in combinations(lines, k) if abs(sum(lines[m] for m in c) - total) <= X.COMPLETE * total]
        alike = lambda m: any(abs(sum(lines[x] for x in c) - lines[m]) <= 2 * X.AGGREGATE * lines[m] for k in range(2, len(lines)) for c in combinations([x for x in lines if x != m], k))  # noqa: B023, E731
        if sets and not any(map(alike, parts)):  # no part is a sum by chance
            assert X.adds_up(list(kept.values()), total)


def test_many_lines_take_no_time():
    lines = {f"own:{i}": 3.0**0.5 * (i + 1) for i in range(20)}
    began = time.perf_counter()
    assert set(X.partition_lines(lines, 1e6)[0]) <= set(lines) and time.perf_counter() - began < 5


def test_votes_and_mapping(spark):
    votes = spark.createDataFrame([("p1", "m", "major"), ("p1", "m", "minor"), ("p2", "m", "dominant"), ("p3", "m", "major")], "product string, input string, bucket string")
    none = spark.createDataFrame([], "product string, input string")
    out = X.requires_edges(votes, none, spark.createDataFrame([("m", 0.2)], "input string, total double"), {"minor": 0.1, "major": 0.4, "dominant": 0.8}).orderBy("product").collect()
    assert [(r.product, r.weight, r.accepted) for r in out] == [("p1", 0.1, True), ("p2", 0.8, False), ("p3", 0.4, True)]
    mapped = spark.createDataFrame([("c", 1, 0.5, "p", 1.0), ("c", 2, 0.3, "p", 0.5)], "company string, line int, share double, product string, fraction double")
    assert [tuple(r) for r in X.produces_edges(mapped).collect()] == [("c", "p", 0.65, "manual", 0.7)]


def test_sections_and_text(spark):
    body = "ITEM 1 Our farms 12\nITEM 7 Results 30\nItem 1: Our farms\n" + "plough " * 500 + "\nItem 7 - Results\n" + "harvest " * 400
    docs = spark.createDataFrame([(1, body, "10-K"), (2, "no items in here", "10-K"), (3, "", "10-K"), (4, body, "another form"), (5, body, None)], "doc_id long, text string, form string")
    found = sorted((r.doc_id, r.name, r.fallback) for r in D.sections(docs).collect())
    assert found == [(1, "1", False), (1, "7", False), (2, "part-1", True), (4, "1", False), (4, "7", False), (5, "1", False), (5, "7", False)]
    html = spark.createDataFrame([("<style>no</style><h2>Sales &lt; costs</h2><table><tr><td>one</td><td>2&nbsp;3</td></tr></table><p>\t4 <br/>5 < 6<i> x</i>",), (None,)], "h string")
    assert [r[0] for r in html.select(D.plain_text(F.col("h"))).collect()] == ["Sales < costs\none 2 3\n4\n5 < 6 x", None]


def test_chunks_against_characters(spark):
    """Spans of at most n characters that end before the last line end in reach, found character by character."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab\n") if rng.random() < 0.25 else "x" for _ in range(rng.randint(0, 90))) for _ in range(60)] + ["", "y" * 50, "\n" * 30, "z" * 10, "z" * 10 + "\n", "\n" + "w" * 25]

    def want(text, n):
        out, lo = [], 0
        while lo < len(text):
            hi = min(lo + n, len(text))
            if hi < len(text) and "\n" in text[lo + 1 : hi]:
                hi = lo + 1 + text[lo + 1 : hi].rindex("\n")
                out.append((lo, hi))
                lo = hi + 1
            else:
                out.append((lo, hi))
                lo = hi
        return out

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.chunks(F.col("t"), 10).alias("c")).collect()
    for r in rows:
        spans, text = [tuple(x) for x in r.c], r.t
        assert "".join(text[a:b] for a, b in spans).replace("\n", "") == text.replace("\n", "") and all(b - a <= 10 for a, b in spans)
        assert len(spans) <= len(want(text, 10)) + text.count("\n")
        if "\n\n" not in text and not text.startswith("\n") and max(map(len, text.split("\n"))) < 10:
            assert spans == want(text, 10)


def test_quotes_names_and_exposures(spark):
    rows = [("Sales  of tractors\n rose (again) by Élan", "of TRACTORS rose (AGAIN) by élan", (7, 40)), ("nothing", "else", None), ("𝒳 some words", "some  words", (2, 12)), ("a.b", "a b", None), (r"x \E y", r"\E y", (2, 6)), ("text", " ", None), (None, "q", None)]
    got = spark.createDataFrame([(t, q) for t, q, _ in rows], "t string, q string").select(D.locate_quote("t", "q").alias("at")).collect()
    assert [r.at and tuple(r.at) for r in got] == [x for _, _, x in rows]
    n = spark.createDataFrame([("Ploughworks Holdings plc", "country:PT", "Outside Europe", "0.370", "own:TractorsAndPumpsMember", "Iberia & Madeira")], "a string, m string, l string, w string, c string, g string")
    row = n.select(D.company_name(F.col("a")), D.region_id(F.col("m"), F.lit("Portugal")), D.region_id(F.col("m"), F.col("l")), D.region_id(F.lit("own:IberiaMember"), F.col("g")), D.exposure_holds(F.col("w"), F.lit(0.3704)), D.exposure_holds(F.col("w"), F.lit(-0.37)), D.member_label(F.col("c"))).first()
    assert tuple(row) == ("Ploughworks", "region/pt", None, "region/iberia-madeira", True, False, "Tractors And Pumps")
    s = spark.createDataFrame([(1, "PLW", "Ploughworks International"), (2, "Springs", "Springs")], "id int, label string, name string")
    assert [r.id for r in D.search(s, "springs").collect()] == [2]
    said = spark.createDataFrame([("rose to 12.4% of sales", 0.12, True), ("about 40 per cent", 0.41, False), ("no figure", 0.1, False)], "q string, share double, ok boolean")
    assert said.filter(D.number_in_quote(F.col("q"), F.col("share")) != F.col("ok")).count() == 0


def test_searches_equal_plain_ones(spark, tmp_path):
    from difflib import SequenceMatcher

    import __spark_entry__ as entry

    def score(a, b):
        return 1.0 if a == b else 0.6 + 0.4 * len(a) / len(b) if a in b else SequenceMatcher(None, a, b).ratio()

    rows = [(k, f"Supplier#{k * 7 % 200:09}") for k in range(200)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    want_part, want_fuzzy = set(), set()
    for k, name in rows[::20]:
        want_part |= {(k, i, round(score(name[-5:], n.lower()), 9)) for i, n in rows if name[-5:] in n}
        best = sorted((-score(f"suplier {name[-5:]}", n.lower()), n, i) for i, n in rows)[:10]
        want_fuzzy |= {(k, i, round(-x, 9)) for x, _, i in best if -x >= 0.6}
    for query, want in (("q_search_substring", want_part), ("q_search_fuzzy", want_fuzzy)):
        got = entry.queries()[query](spark, str(tmp_path)).collect()
        assert {(r["query"], r.id, round(r.score, 9)) for r in got} == want and len(got) == len(want) and {r["query"] for r in got} == set(range(0, 200, 20)), query
    names = spark.createDataFrame([(1, "PLW", "Ploughworks"), (1, "PLW", "Plough-Works Ltd"), (2, "Springs", "Springs"), (3, "N", None)], "id int, label string, name string")
    needles = spark.createDataFrame([(1, "plough works"), (2, " "), (3, None), (4, "SPRINGS"), (5, "plough")], "query int, needle string")
    assert {(r["query"], r.id, round(r.score, 3)) for r in D.searches(names, needles).collect()} == {(1, 1, round(max(score("plough works", "plough works ltd"), score("plough works", "ploughworks")), 3)), (4, 2, 1.0), (5, 1, round(score("plough", "ploughworks"), 3))}


def test_payloads(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"timeline": [{"series": "s", "data": [{"date": "20250102T000000Z", "value": 3, "norm": 9}, {"date": "bad", "value": 1}]}]}))
    assert [(r.day, r.matched, r.norm) for r in P.news_volume(P.news_timeline(spark, str(tmp_path / "v.json"))).collect()] == [(date(2025, 1, 2), 3, 9)]
    chart = {"chart": {"result": [{"meta": {"symbol": "X", "currency": "JPY", "gmtoffset": 32400}, "timestamp": [1735772400, 1735858800], "indicators": {"quote": [{"close": [10.0, None]}], "adjclose": [{"adjclose": [9.0, None]}]}}]}}
    (tmp_path / "p.json").write_text(json.dumps(chart))
    assert [(r.listing, r.day, r.close) for r in P.price_chart(spark, str(tmp_path / "p.json")).collect()] == [("X", date(2025, 1, 2), 10.0)]


def test_records(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "n.yaml").write_text("- {id: company/a, type: company, label: A, aliases: [x]}\n- {id: b, what: 1}\n")
    (tmp_path / "e.yml").write_text("- {src: company/a, rel: PRODUCES, dst: product/p, weight: 0.5, valid_from: 2024-01-01, evidence: [{url: u, accessed: 2024-02-01}]}\n")
    (tmp_path / "bad.yaml").write_text("a: [")
    nodes, edges, problems = records.read_sources(spark, {"seed": str(tmp_path)})
    assert [r.id for r in nodes.collect()] == ["company/a"]
    e = edges.first()
    assert (e.weight, e.valid_from, e.evidence[0].url, e.polarity, e.source) == (0.5, date(2024, 1, 1), "u", 1, "seed")
    assert problems.count() == 2


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"kind": "theme", "key": "k", "day": "2025-01-01", "matched": 1, "norm": 10}) + "\n")
    for _ in range(2):
        C.append_versions(C.coverage_stream(spark, str(folder)), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
        (folder / "b.json").write_text(json.dumps({"kind": "theme", "key": "k", "day": "2025-01-01", "matched": 5, "norm": 10}) + "\n")
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert rows.count() == 2
    assert rows.orderBy(F.desc("recorded_at"), F.desc("row_id")).first().matched == 5


def test_scores_by_steps_equal_difflib():
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abc d") for _ in range(rng.randint(0, 14))) for _ in range(300)} | {"ab" * 120, "abcd" * 60})
    table = D._Names(names, np.arange(len(names)))
    for _ in range(40):
        text = "".join(rng.choice("abc dx") for _ in range(rng.randint(1, 12)))
        got = table._ratios(text, np.arange(len(names)))
        assert got.tolist() == [SequenceMatcher(None, text, str(x)).ratio() for x in table.texts]


@pytest.mark.parametrize(("task_needles", "task_names"), [(3, 40), (250, 20_000)])
def test_searches_score_few_pairs(spark, monkeypatch, task_needles, task_names):
    """The same as scoring every pair; names of several ids, ids of several names, missing labels."""
    monkeypatch.setattr(D, "TASK_NEEDLES", task_needles)
    monkeypatch.setattr(D, "TASK_NAMES", task_names)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 7))) for _ in range(60)]
    names = [(i, None if i % 17 == 0 else f"L{i % 30}", rng.choice(words) + rng.choice(["", " " + rng.choice(words)])) for i in range(90) for _ in range(2)]
    needles = [(q, rng.choice(words) + ("x" if q % 2 else "")) for q in range(12)] + [(98, " "), (99, None)]
    n = spark.createDataFrame(names, "id long, label string, name string")
    found = D.searches(n, spark.createDataFrame(needles, "query int, needle string"), 5)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()

    def score(a, b):
        return 1.0 if a == b else 0.6 + 0.4 * len(a) / len(b) if a in b else SequenceMatcher(None, a, b).ratio()

    want = {}
    for q, a in needles[:12]:
        best = {}
        for i, label, b in names:
            best[i, label] = max(best.get((i, label), 0.0), score(a, b))
        top = sorted((k for k, v in best.items() if v >= 0.6), key=lambda k: (-best[k], k[1] is not None, k[1] or "", k[0]))[:5]
        want |= {(q, *k): pytest.approx(best[k]) for k in top}
    assert {(r.query, r.id, r.label): r.score for r in found.collect()} == want
