"""Each operator against brute force, on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import random
import re
import time
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeline.llm import chat, decontamination, licenses, line_dedup, media, minhash, packing, pages, toxicity, urls
from quakeline.llm.components import components

EXTRA = "doc_id long, text string, lang string, key string, id long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "k", 1) for i, t in enumerate(texts)], EXTRA).repartition(2)


def varied(n=60, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(n // 3)]
    out = list(base)
    while len(out) < n - 4:
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return [*out, None, "", "  \n ", "one"]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_of(n, links):
    root = list(range(n))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_near_duplicates(spark):
    texts = varied()
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components_of(len(texts), links)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(texts))] == [(len(sets[i]), want[i], want[i] == i) for i in range(len(texts))]
    assert minhash.near_duplicates(docs(spark, texts).limit(0)).count() == 0


def test_bands_miss_no_pair_at_the_threshold():
    """Recall of the candidates: pairs of sets at exactly 0.75 share a band."""
    rng = np.random.default_rng(9)
    sets = []
    for n in (4, 8, 28, 140):
        for _ in range(1500):
            union = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            sets += [np.sort(union), np.sort(union[: 3 * n // 4])]
    keys = minhash.min_max_bands(sets)
    shared = (keys[::2] == keys[1::2]).sum(axis=1)
    assert len(shared) == 6000 and shared.min() >= 1 and abs(shared.mean() - minhash.BANDS * 0.75**minhash.ROWS) < 0.5


def test_near_duplicates_of_hot_elements(spark, monkeypatch):
    """Many documents share their rarest words, in several components; repeated ids and null ids too."""
    monkeypatch.setattr(minhash, "HOT", 3)
    rng = random.Random(8)
    base = [[f"w{rng.randrange(60)}" for _ in range(40)] for _ in range(3)]
    base[1][:20], base[2][10:30] = base[0][:20], base[0][10:30]
    texts = []
    for _ in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(40)] = f"w{rng.randrange(60)}"
        texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a, b in combinations(range(60), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components_of(60, links)
    rows = [*enumerate(texts), (5, texts[5]), (None, texts[0])]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 62 and {r.doc_id: r.component_id for r in got if r.doc_id is not None} == dict(enumerate(want)) and [r.kept for r in got if r.doc_id is None] == [True]


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(21)} == {0} and got[31] == 30


def test_contamination(spark):
    rng = random.Random(1)
    words = [f"b{i}" for i in range(40)]
    items = [(1, " ".join(words[:20])), (2, " ".join(words[10:30])), (3, "Tiny, item"), (4, None), (5, ""), (6, "été à l'école " * 3)]
    texts = [" ".join(rng.choice(words[:5]) for _ in range(50)), "x " + " ".join(words[3:14]) + " y", " ".join(words[8:24]).upper(), "a tiny ITEM b", None, "", "été à l'école été à l'école été à", "z " * 5000 + " ".join(words[10:18])]
    want = []
    token = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    for t in texts:
        w, hit, found = token(t), set(), set()
        for k, x in items:
            v = token(x)
            n = min(8, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    found.add(str(k))
                    hit |= set(range(i, i + n))
        want.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontamination.contamination(docs(spark, texts), bench).collect()}
    assert [got[i] for i in range(len(texts))] == want
    clean = {r.doc_id: r.text for r in decontamination.decontaminate(docs(spark, texts), bench).collect()}
    assert clean[1] is not None if 1 in clean else True
    assert 2 not in clean and clean[4] is None and clean[7].strip().endswith("z")


def test_contamination_in_several_passes(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"b{i}" for i in range(60)]
    bench = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for i in range(30)], "item_id long, text string")
    items = [r.text.split() for r in bench.collect()]
    texts = [" ".join([*rng.sample(words, 5), *items[k][:12], "x", *items[(k * 7) % 30][-9:], *["filler"] * 40]) for k in range(30)] + [None, ""]
    df = docs(spark, texts)
    once = sorted(map(tuple, decontamination.contamination(df, bench).collect()))
    cleaned = sorted(map(str, decontamination.decontaminate(df, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 30)
    monkeypatch.setattr(decontamination, "PASS_WORDS", 80)
    assert len(list(decontamination.automata(bench))) > 2
    assert sorted(map(tuple, decontamination.contamination(df, bench).collect())) == once and any(r[2] for r in once)
    assert sorted(map(str, decontamination.decontaminate(df, bench).collect())) == cleaned
    assert decontamination.contamination(df, bench.limit(0)).filter("n_hit > 0").count() == 0 and decontamination.contamination(df.limit(0), bench).count() == 0


def test_packing_keeps_every_id(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    texts = [*varied(), "Ünïcode ÉTÉ it's <|endoftext|> 123 a\u00a0b — (x)", "word. " * 4000, "<|StartOfText|> X", "a" * 3000]
    t = tokenizers.Tokenizer.from_file(path)
    want = [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]
    rows = packing.pack(docs(spark, texts), path, with_ids=True).collect()
    for i, ids in enumerate(want):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids and {r.doc_tokens for r in own} == {len(ids)}
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    for s in {r.sequence_id for r in rows}:
        own = sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= 2048


@pytest.mark.parametrize(("name", "pieces"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_piece_tokenizer_equals_the_library(name, pieces):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path(name)
    library, own, rng = tokenizers.Tokenizer.from_file(path), packing.PieceTokenizer(path), random.Random(1)
    assert own.by_pieces == pieces
    letters = [*"abzAZ éÉñß'sd.,;!?-—“”\u00a0\u0301İΣσς中ไท١²½_<|>09\t\n\x01\x1c\x7f\x85’", "'s", "'re", "<|endoftext|>", "<|EndOfText|>"]
    texts = ["", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(600)), "word " * 3000]
    for lo in range(0, len(texts), 50):
        part = texts[lo : lo + 50]
        ids, at, _ = own.encode([t.encode() for t in part])
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in part]


def test_best_cuts_against_all():
    rng = random.Random(2)
    for _ in range(50):
        at = sorted(rng.sample(range(1, 40), 8))
        cost = [rng.randint(0, 5) for _ in at]
        if max(b - a for a, b in zip([0, *at], at, strict=False)) > 15:
            continue
        value = lambda cuts: sum(cost[k] for k in cuts) + sum(15 - (at[b] - (at[a] if a >= 0 else 0)) for a, b in zip([-1, *cuts], cuts, strict=False))  # noqa: B023, E731
        fits = [c for k in range(1, 9) for c in combinations(range(8), k) if c[-1] == 7 and all(at[b] - (at[a] if a >= 0 else 0) <= 15 for a, b in zip((-1, *c), c, strict=False))]
        assert value(packing.best_cuts(at, cost, 15)) == min(map(value, fits))


def test_toxicity_learns_held_out(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        bad = i % 5 == 0
        w = [f"n{rng.randrange(400)}" for _ in range(30)]
        if bad:
            w[rng.randrange(30)] = rng.choice(["vilewordy", "nastyish", "awfulest"])
        rows.append((i, " ".join(w), "en" if i % 2 else None, int(bad)))
    d = spark.createDataFrame([(*r[:3], 0) for r in rows] + [(900, None, "en", 0), (901, "", "en", 0)], "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(d.drop("toxic"), spark.createDataFrame([(r[0], 1, r[3]) for r in rows], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.toxicity(d, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and sum(got[i].predicted == rows[i][3] for i in held) >= 0.95 * len(held)
    assert 0 <= got[900].score <= 1 and got[900].score == got[901].score
    assert toxicity.without_toxic(d, model).columns == d.columns


def test_line_dedup(spark):
    long = "This line of ordinary length is found in several documents number "
    near = [long + c for c in ("1", "2", "23", "45678")]
    texts = [near[0] + "\nshort", near[1] + "\n" + near[0], near[2] + "\n" + near[3], None, "", near[0], "prefix of forty characters, always the same " + "tail", "é" * 40, "é" * 39 + "ê"] + [f"prefix of forty characters, always the same {i} {i * 7919}" for i in range(30)]
    lines, seen, want = [(i, k, x.strip(" \t\x0b\f\r")) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n"))], [], {}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for i, k, x in lines:
        if len(x) >= line_dedup.LEAST:
            if any(abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2 for y in seen):
                want.setdefault(i, []).append(k)
            seen.append(x)
    got = {r.doc_id: r for r in line_dedup.line_report(docs(spark, texts)).collect()}
    assert {i: list(r.dropped) for i, r in got.items() if r.dropped} == want and got[3].n_lines == 0 and len(got) == len(texts)
    left = {r.doc_id: r.text for r in line_dedup.without_repeats(docs(spark, texts)).collect()}
    assert 5 not in left and left[0] == texts[0] and left[3] is None and left[4] == ""


def words_of(rng, n, of=5000):
    return [f"word{rng.randrange(of)}" for _ in range(n)]


def expected_repeats(rows, limit=2, least=30):
    """By brute force: positions of lines that go and (line, sentence) pairs that go, by (doc_id, text)."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    places = [(d, t, k, x.strip(" \t\x0b\f\r")) for d, t in rows for k, x in enumerate((t or "").split("\n"))]
    seen, said, lines, cut = [], set(), {}, {}
    for d, t, k, x in places:
        if len(x) >= least:
            if any(abs(len(x) - len(y)) <= limit and distance(x, y) <= limit for y in seen):
                lines.setdefault((d, t), []).append(k)
            seen.append(x)
    for d, t, k, x in places:
        if len(x) >= least and k not in lines.get((d, t), []):
            for i, s in enumerate(re.split(r"[.!?]\s", x + " ")):
                s = s.strip(" ")
                if len(s) >= least:
                    if s in said:
                        cut.setdefault((d, t), []).append((k, i))
                    said.add(s)
    return lines, cut


def test_line_dedup_of_hot_keys_and_passages(spark, monkeypatch):
    """Groups of lines with the same beginning, middle or end, and passages inside other lines, against brute force."""
    monkeypatch.setattr(line_dedup, "DIRECT", 0)
    rng = random.Random(5)
    same = " ".join(words_of(rng, 9))
    group = [f"{same} {i * 7919 % 1000:03d} {'x' * (i % 5)}" for i in range(60)] + [f"{i * 7907 % 1000:03d} {same} tail" for i in range(60)] + [f"{same[:40]}{rng.choice('abc')}{same[40:]}{i % 7}" for i in range(40)]
    passage = ". ".join(" ".join(words_of(rng, 10)) for _ in range(6)) + "."
    rows = [(i, "\n".join(rng.sample(group, 4))) for i in range(60)] + [(100, f"Opening words of a document. {passage} And its end."), (101, passage), (102, f"{passage}\n  Other words. {passage} Yes!")]
    lines, cut = expected_repeats(rows)
    assert sum(map(len, lines.values())) > 50 and cut
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.line_report(df).collect()}
    assert {(i, t): list(got[i].dropped) for i, t in rows if got[i].dropped} == lines
    assert {(i, t): [tuple(x) for x in got[i].cut] for i, t in rows if got[i].cut} == cut
    left = {r.doc_id: r.text for r in line_dedup.without_repeats(df).collect()}
    assert left[100] == rows[60][1] and 101 not in left and 102 not in left
    copied = spark.createDataFrame([(0, passage), (1, f"{passage} Something of its own."), (2, "\n".join([f"{' '.join(words_of(rng, 30))}"] * 6))], "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.without_repeats(copied).collect()} == {0, 2}
    more = spark.createDataFrame([(0, passage), (1, f"{' '.join(words_of(rng, 60))}. {passage} Yes!\n {passage}\nThe end.")], "doc_id long, text string")
    assert {r.doc_id: r.text.split()[-3:] for r in line_dedup.without_repeats(more).collect()}[1] == ["Yes!", "The", "end."]


def test_line_keys_count_characters_once_a_line(spark):
    df = spark.createDataFrame([(0, "abcdefghijkl"), (1, "abcdefghijk\u00e9"), (2, "\u00e9bcdefghijkl")], "id long, text string")
    keyed = line_dedup._keyed(df, line_dedup.index_specs(2), 2)
    key = {(r.id, r.spec): r.key for r in keyed.collect()}
    assert key[0, 0] == key[1, 0] != key[2, 0] and key[0, 1] == key[1, 1] == key[2, 1] and key[1, 2] != key[0, 2] == key[2, 2]
    plan = keyed._jdf.queryExecution().optimizedPlan().toString()
    assert "length(" not in plan[: plan.index("Generate")]  # what stands above is worked out for each key


def test_line_dedup_of_rows_that_repeat_an_id(spark):
    one, two, three = ("A line that is long enough, the first of all.", "Quite other words stand in this line, the second.", "And here we have the third line, unlike the others.")
    rows = [(0, one, "x"), (1, one, "x"), (1, two, "y"), (1, two, "z"), (None, one, "n"), (2, None, "t"), (3, f"{three}\n{three}\n{two}", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, version string")
    got = sorted(((r.doc_id, r.text, r.version) for r in line_dedup.without_repeats(df).collect()), key=str)
    assert got == sorted([(0, one, "x"), (1, two, "y"), (1, two, "z"), (None, one, "n"), (2, None, "t"), (3, three, "c")], key=str)
    assert line_dedup.without_repeats(df.limit(0)).count() == 0 and line_dedup.line_report(df.limit(0)).count() == 0


def test_edit_distance_and_index(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(300):
        a = [rng.choice("abé") for _ in range(rng.randint(4, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randrange(len(b) + 1), "a") if rng.random() < 0.4 else b.__setitem__(rng.randrange(len(b)), rng.choice("abé"))
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string").withColumn("near", F.levenshtein("a", "b") <= 2)
    shorter, longer = F.when(F.length("a") <= F.length("b"), F.col("a")).otherwise(F.col("b")), F.when(F.length("a") <= F.length("b"), F.col("b")).otherwise(F.col("a"))
    df = df.withColumns({"s": shorter, "l": longer, "id": F.monotonically_increasing_id()}).cache()
    assert df.filter(line_dedup.within(F.col("a"), F.col("b")) != F.col("near")).count() == 0
    own, probes = (line_dedup._keyed(df.select("id", F.col(c).alias("text")), specs(2), 2).select("id", "key") for c, specs in (("s", line_dedup.index_specs), ("l", line_dedup.probe_specs)))
    assert df.filter("near").join(own.join(probes, ["id", "key"]), "id", "left_anti").count() == 0
    assert df.filter(F.col("near") & ~line_dedup.counts_fit(line_dedup.letter_counts(F.col("a")), line_dedup.letter_counts(F.col("b")))).count() == 0


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "a <|end|>\n \\n \\<| b"), (1, 1, "assistant", "<|start|>user\nx\\"), (1, 2, "user", None), (2, 0, "system", ""), (2, 1, "user", "q"), (3, 5, "assistant", "only")]
    df = chat.with_control_strings(spark, spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digests(chat.examples(df)).collect()}
    for c in (1, 2, 3, -7):
        own = [(r.role, r.text or "") for r in df.filter(F.col("conv_id") == c).orderBy("turn").collect()]
        said, lost = "".join(f"{r}\n{t}\n" for r, t in own), "".join(t for r, t in own if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(own), sha(said), len(lost), sha(lost))


def test_urls(spark):
    rows = [(1, "http://a.NET/x"), (2, "https://b.example.net/en/1?q"), (3, "http://example.com/de/"), (4, "ftp://x.org/fr/a#b"), (5, None), (6, "nothing"), (7, "http://net"), (8, "http://example.com?x://y/z"), (9, "http://planet/x")]
    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: ("a.net", "/x", "net/"), 2: ("b.example.net", "/en/1", "example.net/en/"), 3: ("example.com", "/de/", "example.com/de/"), 4: ("x.org", "/fr/a", "org/fr/"), 5: ("", "", None), 6: ("", "", None), 7: ("net", "", None), 8: ("example.com", "", None), 9: ("planet", "/x", None)}
    learned = [(i, f"http://h{i % 7}.{'net' if i % 2 else 'example.net'}/{'x' if i % 2 else 'en/'}{i}") for i in range(200)] + [(1000, "http://h1.example.io/en/5"), (1001, "http://h1.nets.io/x5")]
    verdict = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(learned, "page_id long, url string")).collect()}
    assert verdict[1000] == "allow" and verdict[1] == "block"


def test_pages(spark):
    menu, note = "<div><ul><li>Shop <b>all</b></li></ul></div>", "<section>Site of the year</section>"
    page = lambda i: f"<html><head><title>t</title><script>if (a<b) x</script></head><body><header>Top</header>{menu}<article><h1>Head {i}</h1>{note}<p>One &amp; t<b>w</b>o {i}<p>Three {i}<!-- no --><div class='comments'>Bad</div><form>Q</form></article><footer>F</footer>"
    rows = [(i, f"http://h.org/{i}", page(i)) for i in range(8)] + [(8, None, "<p>a</p><div class='cookie-notice'>c</div><nav>n</nav>b"), (9, "http://h.org/", None), (10, "http://h.org/z", "")]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"Head {i} One & two {i} Three {i}" for i in range(8)}, 8: "a b", 9: "", 10: ""}


def test_pages_keep_content_that_recurs(spark):
    """Copies and near copies on a host keep their article; no host is no site; large hosts need no fifth of their pages."""
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    other = [(100 + i, f"http://h.org/{i}", f"<html><body><div>{words(i)}</div></body></html>") for i in range(10)]
    same = "<html><body><div><article><p>Copied text</p></article></div></body></html>"
    near = lambda i: f"<html><body><article><p>A paragraph that near copies share</p><p>at {i}</p></article></body></html>"
    plain = "<html><body><div>Bare copy</div></body></html>"
    rows = [*other, *((i, "http://h.org/c", same) for i in range(6)), *((10 + i, "http://h.org/n", near(i)) for i in range(6)), *((20 + i, "http://h.org/b", plain) for i in range(6))]
    rows += [(30 + i, None, f"<body><div>Shared</div><p>own {i}</p></body>") for i in range(6)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(6)} == {"Copied text"} and {got[20 + i] for i in range(6)} == {"Bare copy"}
    assert [got[10 + i] for i in range(6)] == [f"A paragraph that near copies share at {i}" for i in range(6)]
    assert [got[30 + i] for i in range(6)] == [f"Shared own {i}" for i in range(6)] and got[103] == words(3)
    large = [(i, f"http://big.org/{i}", f"<body>{'<div>Ad block</div>' if i % 10 == 0 else ''}<p>own {i}</p></body>") for i in range(12000)]
    assert pages.extract(spark.createDataFrame(large, "page_id long, url string, html string")).filter("text like '%Ad block%'").count() == 0


def test_url_scores_against_brute_force(spark, monkeypatch):
    """Witten-Bell mixtures of whole URLs, worked out character by character; without broadcasts too."""
    rng = random.Random(6)
    rows = [f"http://h{rng.randrange(5)}.{rng.choice(['net', 'example.net', 'org', 'io'])}/{rng.choice(['en', 'fr', 'x'])}/{rng.randrange(40)}?q={rng.randrange(3)}" for _ in range(120)] + [None, "", "no scheme"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    hashed = {r.u: r.h for r in spark.createDataFrame([(u,) for u in set(rows) if u], "u string").select("u", F.pmod(F.xxhash64("u"), F.lit(5)).alias("h")).collect()}
    judged = {r.page_id: r for r in urls.judge(df).collect()}
    says = {rows[i]: r.verdict for i, r in judged.items() if r.rule}
    models = {}
    for c in ("allow", "block"):
        models[c] = [{} for _ in range(urls.ORDER + 1)]
        for u in {u for u in says if says[u] == c and hashed[u] != 0}:
            t = urls.PAD * urls.ORDER + u
            for i in range(urls.ORDER, len(t)):
                for k in range(urls.ORDER + 1):
                    own = models[c][k].setdefault(t[i - k : i], {})
                    own[t[i]] = own.get(t[i], 0) + 1

    def score(u):
        t, total = urls.PAD * urls.ORDER + u, 0.0
        for i in range(urls.ORDER, len(t)):
            for c, sign in (("allow", 1), ("block", -1)):
                p = 1 / urls.ALPHABET
                for k in range(urls.ORDER + 1):
                    if own := models[c][k].get(t[i - k : i]):
                        n, kinds = sum(own.values()), len(own)
                        p = (own.get(t[i], 0) + kinds * p) / (n + kinds)
                total += sign * np.log(p)
        return total / max(1, len(u))

    free = {i: score(rows[i] or "") for i, r in judged.items() if r.rule is None}
    assert len(free) > 20 and all(abs(judged[i].score - v) < 1e-9 for i, v in free.items())
    monkeypatch.setattr(urls, "BROADCAST_GRAMS", 0)
    again = {r.page_id: r for r in urls.judge(df).collect()}
    assert all(again[i].verdict == r.verdict and abs((again[i].score or 0) - (r.score or 0)) < 1e-9 for i, r in judged.items())
    assert urls.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><article><h1>A</h1>one</article><p>between</p><article>two</article><article class=teaser>no</article>", "A one two"),
        ("<main><h1>Title</h1><article><p>Body</p></article><p>Closing</p><aside>x</aside></main><p>out", "Title Body Closing"),
        ("<article><div class='share-price'>Rose</div><p class=social-science>By study</p><div class='share buttons'>x</div><ul class=commentList><li>y</ul></article>", "Rose By study"),
        ("<article><p title=it's>Kept</p><p title='a>b' data-x=\"class='ad'\">too</p><p title=\"hidden gem\">here</p></article>", "Kept too here"),
        ("<p>1 < 2 and </ 3 &lt;b&gt; &amp;amp;<p title=\"never closed>rest", "1 < 2 and </ 3 <b> &amp; rest"),
        ("<div hidden>a</div><div style='display: none'>b</div><p>c<script>if (a</p>) </script>d<!-- <p> -->e<![CDATA[f]]>", "cde"),
        ("<article><article class=comment>no</article><article>in</article>it</article>", "in it"),
        ("<table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul>f\u00a0 g", "a b c d e f g"),
        ("", ""), (None, ""), ("   ", ""), ("no markup", "no markup"), ("<nav>only</nav>", ""),
    ],
)
def test_main_text(page, text):
    assert pages.main_text(page) == text


@pytest.mark.parametrize("part", ["<b ", "<", "</", "<i>", "<p>", "<hr><i>", "<td><i>", "<a ='", '<a b="', "<!--", "<script", "</script <script>", "<b x=1 ", "&", "<p><td><i><hr>", "</i>", "<article>", "<div class=ad>"])
def test_broken_pages_take_linear_time(part):
    began = time.perf_counter()
    pages.main_text("<p>" + part * 20_000)
    assert time.perf_counter() - began < 5


def test_page_corners(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, host string, template string")
    assert pages.extract(empty).count() == 0
    rows = [(1, "http://h.org/", "<article>Same</article>", "a", "t")] * 7 + [(2, "http://h.org/x", "<p>" + "word " * 100_000, None, None), (None, None, None, None, None)]
    got = [(r.page_id, r.url, len(r.text), r.n_chars) for r in pages.extract(spark.createDataFrame(rows, empty.schema)).collect()]
    assert sorted(got, key=str) == sorted([(1, "http://h.org/", 4, 4)] * 7 + [(2, "http://h.org/x", 499_999, 499_999), (None, None, 0, 0)], key=str)


def test_media_round_trip(spark):
    texts = ["", None, "x" * 64, "y" * 65, "é" * 5000, "y" * 65, "long words " * 60_000]
    columns = media.media(docs(spark, texts))
    files = {r.doc_id: r for r in columns.collect()}
    got = {r.doc_id: r for r in media.digests(columns).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r, file = got[i], bytes(files[i].media)
        assert media.wave_payload(file) == full and (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), hashlib.sha256(file).hexdigest())
        mel = media.log_mel(np.frombuffer(full, np.uint8))
        assert np.abs(media.frames(bytes(files[i].tensors)) - mel).max() < 0.01 and r.feature.startswith(f"{len(mel)}x{media.BANDS},") and r.n_segments == len(files[i].spans)
    assert got[3].feature == got[5].feature and got[0].feature == got[1].feature
    assert media.digests(media.media(docs(spark, texts).limit(0))).count() == 0


def slow_resampled(raw):
    """Zero-stuffed by UP, filtered, every DOWN-th sample."""
    x = np.zeros(len(raw) * media.UP)
    x[:: media.UP] = (raw.astype(float) - 128) / 128
    n = media.UP * media.TAPS
    t = np.arange(n) - (n - 1) / 2
    h = media.UP / max(media.UP, media.DOWN) * np.sinc(t / max(media.UP, media.DOWN)) * np.hamming(n)
    return np.convolve(x, h)


def test_log_mel_and_segments_against_brute_force():
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 256, 4096).astype(np.uint8)
    y = media.resampled(raw, 0, 3072)
    lags = [np.abs(slow_resampled(raw)[k :: media.DOWN][: len(y)][100:2900] - y[100:2900]).max() for k in range(media.UP * media.TAPS)]
    assert min(lags) < 1e-4
    assert all(np.allclose(media.resampled(raw, lo, lo + 500), y[lo : lo + 500], atol=1e-6) for lo in (0, 7, 1001))
    mel, (bank, window) = media.log_mel(raw), media._mel()
    for k in (0, 3, len(mel) - 1):
        frame = np.zeros(media.FRAME)
        part = y[k * media.HOP : k * media.HOP + media.FRAME]
        frame[: len(part)] = part
        power = [abs(sum(frame * window * np.exp(-2j * np.pi * f * np.arange(media.FRAME) / media.FRAME))) ** 2 for f in range(media.FRAME // 2 + 1)]
        assert np.allclose(np.log10(np.array(power) @ bank + 1e-6), mel[k], atol=1e-3)
    long = rng.integers(0, 256, 4 * media.HOP * media.TOGETHER // 3 * 2).astype(np.uint8)
    whole = media.log_mel(long)
    assert np.allclose(whole[media.TOGETHER - 2 : media.TOGETHER + 2], media.log_mel(long)[media.TOGETHER - 2 : media.TOGETHER + 2]) and len(whole) > media.TOGETHER
    for _ in range(50):
        energy = rng.normal(0, 1, 40)
        level, on, want = energy - energy.mean(), False, []
        for i, v in enumerate(level):
            now = True if v >= media.LOUD else False if v < media.QUIET else on
            if now and not on:
                want.append([i, i + 1])
            elif now:
                want[-1][1] = i + 1
            on = now
        assert media.segments(energy) == [tuple(x) for x in want]


def test_resampling_keeps_a_tone():
    t = np.arange(8000) / media.RATE
    y = media.resampled((128 + 100 * np.sin(2 * np.pi * 440 * t)).astype(np.uint8), 0, 6000)
    peak = np.abs(np.fft.rfft(y[:6000] - y[:6000].mean())).argmax() * media.RATE * media.UP / media.DOWN / 6000
    assert abs(peak - 440) < 5 and 0.6 < np.abs(y[1000:5000]).max() < 1.0


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"]
    texts = ["x y. " + mit.replace("Software", "Program", 1) + " z", "Released under the MIT License. words Released under the MIT License.", "nothing to see", None, ""]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert got[0].licenses == "MIT" and got[0].coverage > 0.97 and got[1].n_licenses == 2 and got[1].licenses == "MIT-notice" and [got[i].n_licenses for i in (2, 3, 4)] == [0, 0, 0]
    assert licenses.patience([1, 2, 3, 4, 5], [9, 1, 3, 8, 4, 5]) == [(0, 1), (2, 2), (3, 4), (4, 5)]


def test_licenses_against_the_definition(spark):
    """Coverage by longest common subsequences; text of template words only takes no quadratic time."""
    rng = random.Random(3)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = list(row)
            for j, y in enumerate(b, 1):
                row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
        return row[-1]

    for name in ("ISC", "MIT", "BSD-2-Clause"):
        body = re.findall(r"[0-9a-z]+", licenses.TEMPLATES[name].lower())
        for share in (0.0, 0.1, 0.5):
            words = [w for w in body if rng.random() >= share]
            text = " ".join([*(f"x{i}" for i in range(30)), *words, *(f"y{i}" for i in range(30))])
            got = next(iter(licenses.scan_licenses(docs(spark, [text])).collect()))
            if common(body, words) < 0.8 * len(body):
                assert got.n_licenses == 0
            else:
                assert got.licenses == name and got.coverage >= 0.97 * common(body, words) / len(body)
    hashes = np.array(licenses._templates()[0][1] * 1, np.uint64)
    mixed = np.array([rng.choice([h for _, t, _ in licenses._templates() for h in t]) for _ in range(30_000)], np.uint64)
    began = time.perf_counter()
    licenses.find(mixed, licenses._templates())
    assert time.perf_counter() - began < 10 and len(hashes)
