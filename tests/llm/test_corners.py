"""Nulls, repeated rows, long texts, empty tables and columns with clashing names, for each operator that reads rows alone."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeline.llm import chat, decontamination, licenses, line_dedup, media, minhash, packing, toxicity, urls

LONG = "word " * 60_000
#: Names that operators use inside.
CLASH = ["score", "key", "id", "value", "text_", "gram", "says", "n", "version", "pos", "line", "words", "held_out", "component_id", "spans", "_row", "_text", "_key", "_marks"]


def table(spark, rows, empty=False):
    df = spark.createDataFrame([(*r, *range(len(CLASH))) for r in rows], "doc_id long, text string, lang string, " + ", ".join(f"`{c}` int" for c in CLASH))
    return df.limit(0) if empty else df.repartition(3)


ROWS = [(1, "Some words of a text that is long enough to count here.", "en"), (1, "Some words of a text that is long enough to count here.", "en"), (1, "Other words under the same id, quite another text.", "de"), (2, None, None), (3, "", "en"), (4, LONG, "en"), (None, "no id", None), (5, "é\u0000𝒳\n\n \t", "xx")]


def answers(spark):
    bench = spark.createDataFrame([(1, "some words of a text that is long"), (None, None), (2, "")], "item_id long, text string")
    model = toxicity.fit(table(spark, ROWS), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    return {
        "toxicity": lambda d: toxicity.toxicity(d, model), "licenses": licenses.scan_licenses, "media": lambda d: media.digests(media.media(d)), "lines": line_dedup.line_report,
        "contamination": lambda d: decontamination.contamination(d, bench), "minhash": minhash.near_duplicates, "kept": lambda d: toxicity.without_toxic(d, model), "cut": lambda d: decontamination.decontaminate(d, bench),
    }


@pytest.mark.parametrize("name", ["toxicity", "licenses", "media", "lines", "contamination", "minhash", "kept"])
def test_one_answer_a_row(spark, name):
    apply = answers(spark)[name]
    got = apply(table(spark, ROWS)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert apply(table(spark, ROWS, empty=True)).count() == 0
    ones = sorted(str(r) for r in got if r.doc_id == 1)
    assert len(set(ones)) <= 2 and (name == "lines" or ones.count(ones[0]) + ones.count(ones[-1]) >= 3)


def test_columns_come_back(spark):
    for name in ("kept", "cut"):
        out = answers(spark)[name](table(spark, ROWS))
        assert out.columns == ["doc_id", "text", "lang", *CLASH] and [tuple(r) for r in out.select(*CLASH).distinct().collect()] == [tuple(range(len(CLASH)))]
    out = line_dedup.without_repeats(table(spark, ROWS))
    assert out.columns == ["doc_id", "text", "lang", *CLASH] and {r.doc_id for r in out.collect()} == {1, 2, 3, 4, None, 5}


def test_packing_of_repeated_rows(spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    got = packing.pack(table(spark, ROWS), path)
    assert got.agg(F.sum("length")).first()[0] == sum({(r.doc_id, r.doc_tokens): r.doc_tokens * (2 if r.doc_id == 1 and r.ids_crc32 in _twice(got) else 1) for r in got.collect()}.values())
    assert packing.pack(table(spark, ROWS, empty=True), path).count() == 0


def _twice(pieces):
    return {r.ids_crc32 for r in pieces.groupBy("doc_id", "ids_crc32", "start").count().filter("count > 1").collect()}


def test_chat_corners(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, 0, "assistant", "lost"), (None, None, None, None), (-7, 5, "assistant", "mine"), (2, 0, "assistant", LONG), (3, 0, "assistant", "")]
    df = spark.createDataFrame([(*t, 0, 0, 0) for t in turns], "conv_id long, turn long, role string, text string, target int, formatted int, t int")
    got = {r.conv_id: r for r in chat.digests(chat.examples(chat.with_control_strings(spark, df))).collect()}
    said = {1: "aa", None: "lost", -7: "</s>[INST] ok [/INST]mine", 2: LONG, 3: ""}
    assert {k: (r.loss_chars, r.loss_sha256) for k, r in got.items()} == {k: (len(t), hashlib.sha256(t.encode()).hexdigest()) for k, t in said.items()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, None: 2, -7: 3, 2: 1, 3: 1}
    assert chat.digests(chat.examples(df.limit(0))).count() == 0


def test_url_corners(spark):
    rows = [(1, "http://a.net/x"), (1, "http://a.net/x"), (2, None), (3, ""), (None, "http://b.org/fr/"), (4, "http://c.io/" + "x" * 20_000)]
    df = spark.createDataFrame([(*r, "h", "t", "s", 1, 2) for r in rows], "page_id long, url string, host string, text string, says string, gram int, score int")
    got = urls.judge(df).collect()
    assert sorted((str(r.page_id), r.host, str(r.rule)) for r in got) == sorted([("1", "a.net", "net/"), ("1", "a.net", "net/"), ("2", "", "None"), ("3", "", "None"), ("None", "b.org", "org/fr/"), ("4", "c.io", "None")])
    assert urls.judge(df.limit(0)).count() == 0


def test_convolution_against_loops():
    """Pooled filters of several texts at once equal those of each text by itself, word by word; cuts are the best."""
    rng, model = np.random.default_rng(4), toxicity.Model.fresh()
    model.bias[:] = rng.normal(0, 0.05, len(model.bias))
    model.embedding[toxicity.BUCKETS] = 0
    model.keep[rng.integers(0, toxicity.BUCKETS, 500)] = False
    texts = [rng.integers(0, toxicity.BUCKETS, (n, 2)).astype(np.int32) for n in (0, 1, 2, 3, 7, 40, 0, 5)]
    best, _ = model.pooled(np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    for t, got in zip(texts, best, strict=True):
        words = [sum((model.embedding[i].astype(float) for i in pair if model.keep[i]), np.zeros(toxicity.WIDTH)) for pair in t]
        words += [np.zeros(toxicity.WIDTH)] * (max(toxicity.WIDTHS) - 1)
        want = []
        for w, kernel in zip(toxicity.WIDTHS, model.kernels, strict=True):
            spans = [sum(words[i + j] @ kernel[j].astype(float) for j in range(min(w, len(words) - i))) for i in range(len(words))]
            want += list(np.max(spans, axis=0) if spans else np.zeros(toxicity.FILTERS))
        assert np.allclose(got, np.maximum(np.array(want) + model.bias, 0), atol=1e-4)
    for _ in range(50):
        values, labels = rng.integers(0, 8, 20) / 8, rng.integers(0, 2, 20)
        f1 = lambda cut: 2 * (labels[values >= cut]).sum() / ((values >= cut).sum() + max(1, labels.sum()))  # noqa: B023, E731
        assert np.isclose(f1(toxicity.best_cut(values, labels)), max(map(f1, values)))
