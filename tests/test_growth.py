"""Answers, candidates and their selection, news queries, markets, writers and the ledger."""

import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from quakeline.operators import answers as A
from quakeline.operators import documents as D
from quakeline.operators import growth as G
from quakeline.operators import returns as R
from quakeline.sources import records

TITLES = [(1, "HRBR", "Harbor Foods Systems Inc"), (2, "HRBX", "Harbour Freight Co"), (3, "MLL", "Mill & Grain plc"), (4, "QRY", "Quarry Stone Corp")]


def test_names_and_tickers(spark):
    said = [("Harbor Foods", None), ("Harbor Foods", "MLL"), ("Harbour Freight", None), ("Mill Grain", "mll"), ("Nobody", None), ("", "QRY"), ("Quarry Stones", "QRY"), (None, None)]
    got = D.resolve_names(spark.createDataFrame(said, "mention string, ticker string"), spark.createDataFrame(TITLES, "id int, ticker string, title string"))
    assert {(r.mention, r.ticker): r.id for r in got.collect()} == {said[0]: 1, said[1]: 1, said[2]: 2, said[3]: 3, said[6]: 4}
    assert {r.mention: round(r.score, 3) for r in got.filter("ticker is null").collect()}["Harbor Foods"] == 0.9


def answer(*companies):
    return json.dumps({"companies": [dict(zip(("name", "ticker", "role", "products", "quote"), c, strict=True)) for c in companies]})


def test_candidates(spark):
    text = "We buy flour from Mill & Grain plc and stone\nfrom Quarry Stone. Oat Barn is a rival of Harbor Foods."
    rows = [
        ("company/a", "1", 100, text, answer(("Mill & Grain", None, "supplier", ["product/flour", "product/none"], "flour  from MILL"), ("Oat Barn", None, "rival", [], "Oat Barn is"), ("Other", None, "x", [], "not there"))),
        ("company/b", "1", 0, text, answer(("Mill and Grain plc", "MLL", "supplier", ["product/bran"], "Mill & Grain"), ("Harbor Foods", None, "self", [], "Harbor Foods"))),
        ("company/c", "7", 0, text, None), ("company/d", "7", 0, text, "{broken"),
    ]
    answers = spark.createDataFrame(rows, "filer string, section string, section_start int, text string, answer string")
    found = G.mentioned(answers, spark.createDataFrame(TITLES, "id int, ticker string, title string"), spark.createDataFrame([("company/b", 1)], "filer string, cik int"))
    assert found.filter("start is null").count() == 1 and found.count() == 4
    taxonomy = spark.createDataFrame([("product/flour",), ("product/bran",)], "id string")
    got = {r.candidate: (r.name, r.cik, r.products, r.n_filers, r.n_mentions) for r in G.candidates(found, taxonomy).collect()}
    assert got == {"cik:3": ("Mill & Grain", 3, ["product/bran", "product/flour"], 2, 2), "name:oat barn": ("Oat Barn", None, [], 1, 1)}
    assert found.filter("name = 'Mill & Grain'").first().start == 100 + text.index("flour from")


@pytest.mark.parametrize("cap", [0, 1, 2, 3, 9])
def test_selection_against_a_loop(spark, cap):
    rows = [(f"cik:{i}", f"n{i % 7}", None if i == 3 else i, ["p"] if i % 5 else [], i % 3, i % 4) for i in range(20)]
    known, rejected, forms = {4, 6}, {7: "no"}, {i: "10-K" for i in range(20) if i % 4 != 1}
    want, added = {}, 0
    for key, name, cik, products, filers, n in sorted(rows, key=lambda r: (-r[4], -r[5], r[1], r[0])):
        if cik is None:
            want[key] = "not a filer"
        elif cik in known:
            want[key] = "already in the universe"
        elif cik in rejected:
            want[key] = "rejected in review: no"
        elif not products:
            want[key] = "makes no known product"
        elif added >= cap:
            want[key] = "over cap"
        elif cik not in forms:
            want[key] = "no annual report"
        else:
            want[key], added = "added", added + 1
    df = spark.createDataFrame(rows, "candidate string, name string, cik int, products array<string>, n_filers int, n_mentions int")
    got = G.select_additions(df, spark.createDataFrame([(i,) for i in known], "cik int"), spark.createDataFrame(list(rejected.items()), "cik int, reason string"), spark.createDataFrame(list(forms.items()), "cik int, form string"), cap)
    assert {r.candidate: r.decision for r in got.collect()} == want


def test_ids_forms_and_queries(spark):
    added = spark.createDataFrame([("a", "Mill & Grain plc", 3), ("b", "Mill Grain", 5), ("c", "Taken Inc", 6)], "candidate string, name string, cik int")
    assert {r.candidate: r.id for r in G.new_ids(added, spark.createDataFrame([("company/taken",)], "id string")).collect()} == {"a": "company/mill-grain", "b": "company/mill-grain-5", "c": "company/taken-6"}
    filings = spark.createDataFrame([(1, "10-K", date(2022, 1, 1)), (1, "20-F", date(2024, 1, 1)), (2, "10-K", date(2020, 1, 1))], "cik int, form string, filing_date date")
    assert [tuple(r) for r in G.recent_forms(filings, "2025-01-01").collect()] == [(1, "20-F")]
    names = spark.createDataFrame([("Mill, ", ["Mill,", " Mill", "MG", "1234", "Grain Co"]), ("MG", None)], "label string, aliases array<string>")
    assert [r[0] for r in names.select(G.company_query()).collect()] == ['("Mill" OR "Grain Co")', None]
    assert [r[0] for r in spark.createDataFrame([(" a OR b\n",), ("  ",), (None,)], "query string").select(G.theme_query()).collect()] == ["a OR b", None, None]


def test_checked_answers(spark):
    text = "Each mill needs steel rollers. Bakeries were 12.5% of our sales. Harbor Foods buys from Quarry Stone. We make flour."
    items = {
        "requires": [{"product": "product/mill", "input": "product/rollers", "bucket": "major", "reason": "r", "quote": "needs STEEL"}, {"product": "product/mill", "input": "product/mill", "quote": "needs steel"}, {"product": "product/mill", "input": "product/paint", "quote": "needs steel"}],
        "disclosed": [{"share": 0.125, "quote": "12.5% of our sales", "products": ["product/mill"]}, {"share": 0.3, "quote": "12.5% of our sales"}, {"share": 0.125, "quote": "nowhere"}],
        "produces": [{"product": "product/flour", "quote": "We make flour"}, {"product": "product/none", "quote": "We make"}],
        "supplies": [{"supplier": "Quarry Stone Corp", "customer": "Harbor Foods", "product": "product/none", "quote": "buys from"}, {"supplier": "Quarry Stone", "customer": "Quarry Stone Corp", "quote": "buys from"}, {"supplier": "Who", "customer": "Harbor Foods", "quote": "buys from"}],
        "new_products": [{"label": "Bread", "quote": "Bakeries"}],
    }
    answers = spark.createDataFrame([("company/a", "10-K", "1", 1000, text, json.dumps(items)), ("company/b", "10-K", "1", 0, text, None)], "node string, form string, section string, section_start int, text string, answer string")
    taxonomy = spark.createDataFrame([("product/mill", "Mills", None), ("product/rollers", "Rollers", ["steel roller"]), ("product/paint", "Paint products", None), ("product/flour", "Wheat flours", None)], "id string, label string, aliases array<string>")
    names = spark.createDataFrame([("company/q", "Quarry Stone", "Quarry Stone"), ("company/h", "Harbor", "Harbor Foods")], "id string, label string, name string")
    got = A.checked(answers, taxonomy, names).cache()
    kept = {r.kind: r for r in got.filter("kept").collect()}
    assert got.filter("kept").count() == 5 and set(kept) == set(A.KINDS) and {r.kind: r.dropped for r in A.dropped(got).collect()} == {"requires": 2, "disclosed": 2, "produces": 1, "supplies": 2}
    assert (kept["supplies"].supplier, kept["supplies"].customer, kept["supplies"].product) == ("company/q", "company/h", None)
    import hashlib

    at = text.index("needs steel")
    assert kept["requires"].start == 1000 + at and kept["requires"].item_id == "req-" + hashlib.sha256(f"company/a|requires|1|product/mill|product/rollers|{at}".encode()).hexdigest()[:10]
    assert kept["disclosed"].item_id == "dis-" + hashlib.sha256(f"company/a|disclosed|1|0.125|{text.index('12.5')}".encode()).hexdigest()[:10]
    seed = spark.createDataFrame([("product/mill", "product/rollers"), ("product/mill", "product/paint")], "product string, input string")
    assert {r.input: r.found for r in A.requires_recall(seed, got.filter("kept and kind = 'requires'")).collect()} == {"product/rollers": True, "product/paint": False}


def test_companies_are_matched_without_a_common_word(spark):
    from difflib import SequenceMatcher

    rng = random.Random(5)
    names = ["Ploughworks", "Data Dog", "Quarry-Stone Works", "X", "Ab", "aa aa aa aa", ""] + ["".join(rng.choice("abc  dé") for _ in range(rng.randrange(1, 16))) for _ in range(250)]
    edited = lambda t: "".join(rng.choice(["", c + rng.choice("ab é"), rng.choice("abcd")]) if rng.random() < 0.1 else c for c in t)
    said = ["Ploughwork Inc", "Datadog", "Quarry Stoneworks", "x", "aB", "aaaa aaaa", "", None] + [edited(t) for t in names for _ in range(3)]
    norm = lambda t: " ".join(t.lower().replace("-", " ").split())

    def score(a, b):
        return 1.0 if a == b else 0.6 + 0.4 * len(a) / len(b) if a in b else SequenceMatcher(None, a, b).ratio()

    needles, own = {norm(t) for t in said if t} - {""}, {norm(t) for t in names} - {""}
    frame = lambda rows: spark.createDataFrame([(t,) for t in rows], "text string")
    want = {(a, b) for a in needles for b in own if score(a, b) >= A.LEAST_SCORE}
    got = A.alike_names(frame(needles | {""}), frame(own | {""})).collect()
    assert {(r.needle, r.name) for r in got} == want and len(got) == len(want) > 300
    firms = spark.createDataFrame([(f"company/{i:03}", t, t) for i, t in enumerate(names)], "id string, label string, name string")
    found = {r.name: r.company for r in A.matched_companies(spark.createDataFrame([(t,) for t in said[:4] + [None, ""]], "name string"), firms).collect()}
    assert found == {"Ploughwork Inc": "company/000", "Datadog": "company/001", "Quarry Stoneworks": "company/002", "x": "company/003"}


def test_markets_and_rates(spark):
    want = {"ABC": "^GSPC", "1.T": "^N225", "5.KS": "^KS11", "B.DE": "^GDAXI", "A.PA": "^FCHI", "^N225": "^N225", "^NONE": None, "X.YY": None, "JPY=X": None}
    assert {r.listing: r.i for r in spark.createDataFrame([(k,) for k in want], "listing string").select("listing", R.market_index().alias("i")).collect()} == want
    quotes = spark.createDataFrame([("JPY=X", date(2025, 1, 2), 125.0), ("EURUSD=X", date(2025, 1, 2), 1.25), ("KRW=X", date(2025, 1, 2), 0.0), ("ABC", date(2025, 1, 2), 3.0)], "listing string, day date, adj_close double")
    assert {r.currency: r.rate for r in R.dollar_rates(quotes).collect()} == {"JPY": 1 / 125, "EUR": 1.25}


def test_records_and_rulings_are_written(spark, tmp_path):
    pytest.importorskip("yaml")
    label = "a \"quoted\" – label: \\ #\n\x85\u2028\x7f é 𝒳 {x}"
    nodes = spark.createDataFrame([("company/a", "company", label, ["x, y", "- z"], None)], "id string, type string, label string, aliases array<string>, country string")
    edges = spark.createDataFrame([("company/a", "PRODUCES", "product/p", 0.5, date(2024, 1, 1))], "src string, rel string, dst string, weight double, valid_from date")
    records.write_records(nodes, str(tmp_path / "s" / "nodes"))
    records.write_records(edges, str(tmp_path / "s" / "edges"))
    n, e, problems = records.read_sources(spark, {"s": str(tmp_path / "s")}, "part-*")
    assert problems.count() == 0 and [(r.id, r.label, r.aliases, r.country) for r in n.collect()] == [("company/a", label, ["x, y", "- z"], None)]
    assert [(r.src, r.weight, r.valid_from) for r in e.collect()] == [("company/a", 0.5, date(2024, 1, 1))]
    ledger, day = str(tmp_path / "ledger"), date(2025, 1, 1)
    schema = "edge string, url string, note_hash string, ruling string, date date, by string, reason string"
    records.append_rulings(spark.createDataFrame([("e-1", "u", "n", "dead-link", day, "me", "gone"), ("e-2", "u", "n", "verified", day, "me", None)], schema), ledger)
    records.append_rulings(spark.createDataFrame([("e-1", "u", "n", "verified", day, "me", "")], schema), ledger)
    with pytest.raises(Exception, match="unknown ruling"):
        records.append_rulings(spark.createDataFrame([("e-2", "u", "n", "fine", day, "me", "")], schema), ledger)
    whole = records.read_ledger(spark, ledger)
    rulings = D.latest_rulings(whole)
    assert whole.count() == 3 and {r.edge: r.ruling for r in rulings.collect()} == {"e-1": "verified", "e-2": "verified"}
    items = spark.createDataFrame([(f"e-{i}", "u" if i < 4 else "v", "n", s, f"l{i}") for i, s in enumerate(["seed", "llm", "xbrl", "llm", "seed", "x", "review"])], "edge string, url string, note_hash string, source string, label string")
    assert [(r.url, r.edge, r.unruled) for r in D.unruled_documents(items, rulings).collect()] == [("v", "e-6", 3), ("v", "e-4", 3), ("v", "e-5", 3), ("u", "e-0", 2), ("u", "e-3", 2)]
    assert D.verification_status(items, whole.filter("ruling = 'dead-link'")).filter("failed = 1").count() == 1
