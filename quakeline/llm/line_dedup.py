"""Line deduplication by a segment-partition edit join, in DataFrame operations only.

Equal lines are merged first, with a pre-aggregated minimum of their places. Two lines within LIMIT edits share one
of LIMIT + 1 segments of the shorter one, at a place that moves by few characters only. So each distinct line puts
its own segments in an index, keyed by length, segment number and text, and probes the index for every length up to
LIMIT below its own at the few places that the multi-match rule leaves. Pairs that meet are verified by a banded
bit-parallel edit distance: the 2 * LIMIT + 1 cells of a column are the bits of one number.

A segment that many lines share is a hot key. It stands in the index as one row, and its lines meet again on the
rest: cut the shared segment out of both, and the rests are within LIMIT edits too, so they share a segment of the
rest. This narrows a hot key round by round, so that no group is gathered and few pairs are made.

Lines that are left may still hold passages of other documents, wrapped or edited otherwise. So equal sentences are
merged as well: a sentence of at least LEAST characters that an earlier line holds is cut out of its line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeline.llm.common import stored

LIMIT = 2
#: Shorter lines and sentences (in characters, without outer white space) are left alone: list marks, braces, headings
#: and phrases of that size recur in texts that are no copies of each other.
LEAST = 30
#: While hot keys are narrowed, a key of more lines than this stays hot; rounds; pairs of hot keys that are tested without.
HOT, ROUNDS, DIRECT = 8, 5, 2_000_000
#: Tables of up to this number of rows of a few numbers are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: A document that repeats COPIED characters of other documents at least, and nothing of its own, goes if less than one
#: in LEFT of its characters is left: a near copy, of which only the edited parts would stay.
LEFT, COPIED = 3, 200
#: Where a sentence ends: the mark and the space are no part of it when sentences are compared, and stay when one is cut.
SENTENCE_END, SENTENCE_CUT = r"[.!?]\s", r"(?<=[.!?])(?=\s)"


#: ASCII white space that a line can hold.
SPACE = " \t\x0b\f\r"


def trimmed(line: Column) -> Column:
    """A line without ASCII white space at its ends; two lines count as equal if these are."""
    edge = F.lit(False)
    for x in SPACE:
        edge = edge | line.startswith(x) | line.endswith(x)
    return F.when(edge, F.btrim(line, F.lit(SPACE))).otherwise(line)


def _version(text: Column | str = "text") -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(text)


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, version, pos (from 0), line (trimmed) of every line that takes part."""
    each = docs.select(F.col("doc_id").cast("long"), _version().alias("version"), "text")  # once a document, not once a line
    each = each.select("doc_id", "version", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).filter("doc_id is not null")
    return each.filter(F.length("line") >= LEAST).withColumn("line", trimmed(F.col("line"))).filter(F.length("line") >= LEAST)


def _hashes(c: str) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(1), c).alias("h2")]


def _small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, broadcast if a count allows it."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def index_specs(limit: int) -> list[tuple[int, int, int]]:
    """(characters shorter, segment, shift) of a line's own segments."""
    return [(0, i, 0) for i in range(limit + 1)]


def probe_specs(limit: int) -> list[tuple[int, int, int]]:
    """Where any line at most as long, within limit edits, has a segment in the index: the multi-match rule."""
    return [(d, i, s) for d in range(limit + 1) for i in range(limit + 1) for s in range(max(-i, d - (limit - i)), min(i, d + (limit - i)) + 1)]


def _span(length: Column, i: Column, limit: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i of limit + 1; the last ones are longer by one."""
    n = limit + 1
    short = F.call_function("div", length, F.lit(n)).cast("int")
    longer = length - short * n
    return i * short + F.greatest(F.lit(0), longer - (F.lit(n) - i)), short + (i >= F.lit(n) - longer).cast("int")


def _spec_literals(specs: list[tuple[int, int, int]]) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("spec"), F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("s")) for k, (d, i, s) in enumerate(specs)))


def _segment(of: str, limit: int, counted: bool = False) -> tuple[Column, Column, Column]:
    """Length of the indexed line, and place (from 0) and size of the segment, of a row's text by its column `of`; counted: its length is in column `chars`."""
    n = (F.col("chars") if counted else F.length("text")) - F.col(f"{of}.d")
    start, size = _span(n, F.col(f"{of}.i"), limit)
    return n, start + F.col(f"{of}.s"), size


def _keyed(rows: DataFrame, specs: list[tuple[int, int, int]], limit: int, group: str | None = None, gap: str | None = None) -> DataFrame:
    """rows (with id, text) once for each spec: id, text, key, spec (its number), gap in length, at and size of the segment in text.

    A row makes one key at a time, so that the work is one short loop of compiled code. With group the key is one
    within that group. With gap, only the specs of that difference of lengths count. A row's characters are counted
    once, and a segment of a text of single bytes is cut out by its place, without a search from the beginning.
    """
    chars = F.length("text")
    each = rows.withColumns({"chars": chars, "bytes": F.when(F.octet_length("text") == chars, F.col("text").cast("binary"))})
    each = each.withColumn("of", F.explode(_spec_literals(specs)))
    if gap:
        each = each.filter(F.col("of.d") == F.col(gap))
    n, at, size = _segment("of", limit, counted=True)
    segment = F.coalesce(F.substring(F.col("bytes"), at + 1, size), F.substring(F.col("text"), at + 1, size).cast("binary"))
    key = F.xxhash64(*([F.col(group)] if group else []), n, F.col("of.i"), segment)
    return each.select("id", "text", key.alias("key"), F.col("of.spec").alias("spec"), F.col("of.d").alias("gap"), at.alias("at"), size.alias("size"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def within(a: Column, b: Column, limit: int = LIMIT) -> Column:
    """Whether the edit distance of a and b is at most limit: banded bit-parallel columns. Both are at least limit long.

    Bit k of a column j stands for row j - limit + k. vp and vn hold the vertical steps up and down, d the distance
    along the last diagonal of the band and then along the last row.
    """
    width = 2 * limit + 1
    full, top = (1 << width) - 1, width - 1
    bit = lambda x, k: F.call_function("shiftright", x, k).bitwiseAND(F.lit(1))
    either = lambda x, y: x.bitwiseOR(F.bitwise_not(y).bitwiseAND(F.lit(full)))  # noqa: E731  x or not y

    def column(rows: Column, below: Column, s: Column, x: Column) -> Column:
        j, c = x["j"], x["c"]
        same = sum((F.when(F.get(rows, j + (k - limit - 1)) == c, 1 << k).otherwise(0) for k in range(width)), F.lit(0))

        def after(d: Column) -> Column:
            hp, hn, low = either(s["vn"], d.bitwiseOR(s["vp"])), d.bitwiseAND(s["vp"]), F.shiftright(d, 1)
            past = j - below  # columns since the band met the last row
            cost = F.when(past <= 0, 1 - bit(d, F.lit(top))).otherwise(bit(hp, top - past) - bit(hn, top - past))
            return F.struct(either(hn, low.bitwiseOR(hp)).alias("vp"), low.bitwiseAND(hp).alias("vn"), (s["d"] + cost).alias("d"))

        v = s["vp"]
        diagonal = lambda e: (e.bitwiseAND(v) + v).bitwiseXOR(v).bitwiseOR(e).bitwiseOR(s["vn"]).bitwiseAND(F.lit(full))
        return _let(same, lambda e: _let(diagonal(e), after))

    start = F.struct(F.lit(full ^ ((1 << limit) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(limit).alias("d"))
    steps = F.transform(F.split(b, ""), lambda c, i: F.struct((i + 1).alias("j"), c.alias("c")))
    m = F.length(a)
    distance = _let(F.split(a, ""), lambda rows: _let(m - limit, lambda below: F.aggregate(steps, start, lambda s, x: column(rows, below, s, x))["d"]))
    return (F.abs(m - F.length(b)) <= limit) & (distance <= limit)


def _common(a: Column, b: Column) -> Column:
    """Length of the longest common beginning, by halving steps."""

    def search(x: Column, y: Column, n: Column) -> Column:
        steps = F.transform(F.sequence(F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
        same = lambda p, s: (p + s <= n) & (F.substring(x, p + 1, s) == F.substring(y, p + 1, s))
        return F.aggregate(steps, F.lit(0), lambda p, s: F.when(same(p, s), p + s).otherwise(p))

    return _let(a, lambda x: _let(b, lambda y: _let(F.least(F.length(x), F.length(y)), lambda n: search(x, y, n))))


def one_gap(a: Column, b: Column) -> Column:
    """False only for rests (as of `differing`, before the filling) that are more than two edits apart.

    Their first and last characters differ, so of two edits one is at either end: past the first, they are equal up
    to the last.
    """
    m, n = F.length(a), F.length(b)
    past = lambda i, j: _common(F.substring(a, i + 1, m), F.substring(b, j + 1, n)) >= F.least(m - i, n - j) - 2
    return (F.least(m, n) <= 4) | past(1, 1) | past(1, 0) | past(0, 1)


def differing(a: str, b: str) -> tuple[list[Column], list[Column], Column, Column]:
    """Columns in three steps that cut the common beginning and end off columns a and b: lengths, then the rests.

    The distance of the rests is that of the lines.
    """
    front = _common(F.col(a), F.col(b)).alias("_front")
    rest = [F.reverse(F.substring(F.col(c), F.col("_front") + 1, F.length(c))).alias(f"_r{c}") for c in (a, b)]
    back = _common(F.col(f"_r{a}"), F.col(f"_r{b}"))
    return [front], rest, *(F.reverse(F.substring(F.col(f"_r{c}"), back + 1, F.length(f"_r{c}"))) for c in (a, b))


#: Letters whose counts bound the distance from below: an edit changes two of them by one at most.
GROUPS = ("eatoinsr", "hldcuf .")
#: Parts into which the probes of a key that stays hot are dealt.
SALTS = 16


def letter_counts(line: Column) -> Column:
    """Counts of each letter, modulo 256, as the bytes of two numbers. Lines within the limit differ by few in each."""
    count = lambda g: (F.length(line) - F.length(F.replace(line, F.lit(g), F.lit("")))) % 256
    packed = []
    for letters in GROUPS:
        out = F.lit(0).cast("long")
        for k, g in enumerate(letters):
            out = out.bitwiseOR(F.shiftleft(count(g).cast("long"), 8 * k))
        packed.append(out)
    return F.struct(*(x.alias(f"c{k}") for k, x in enumerate(packed)))


def counts_fit(a: Column, b: Column, limit: int = LIMIT) -> Column:
    """False only for lines further apart than limit."""
    byte = lambda x, k: F.shiftright(x, 8 * k).bitwiseAND(F.lit(255))
    apart = lambda w, k: F.abs(F.pmod(byte(a[f"c{w}"], k) - byte(b[f"c{w}"], k) + 128, F.lit(256)) - 128)
    parts = [apart(w, k) for w, letters in enumerate(GROUPS) for k in range(len(letters))]
    return sum(parts[1:], parts[0]) <= 2 * limit


def placed_lines(docs: DataFrame) -> DataFrame:
    """id, doc_id, version, pos, line, h1, h2 of every line that takes part. Stored, so that ids are fixed."""
    return stored(lines_of(docs).select(F.monotonically_increasing_id().alias("id"), "doc_id", "version", "pos", "line", *_hashes("line")))


def _later(units: DataFrame, place: list[str], placed: DataFrame | None = None) -> DataFrame:
    """Of units (id, h1, h2 and place, or its part that placed has not by id) those that may share (h1, h2): id, place,
    first, the least place and id that have them, and repeats, whether the own place is another. Stored."""
    twice = _small(stored(units.groupBy("h1").count().filter("count > 1").select("h1")))  # one number as key; what it mixes up is told apart below
    found = units.join(twice, "h1", "left_semi")
    if placed is not None:
        found = found.join(_small(stored(found.select("id").distinct()).join(placed, "id")), "id")
    found = stored(found)
    first = found.groupBy("h1", "h2").agg(F.min(F.struct(*place, "id")).alias("first"))
    both = found.join(_small(first), ["h1", "h2"])
    return stored(both.select("id", *place, "first", (F.struct(*place) != F.struct(*(f"first.{c}" for c in place))).alias("repeats")))


def _rest(text: Column | str, at: Column, size: Column) -> Column:
    """The text without a segment."""
    text = F.col(text) if isinstance(text, str) else text
    return F.concat(F.substring(text, F.lit(1), at), F.substring(text, at + size + 1, F.length(text)))


def meeting(lines: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Pairs (a, b) of ids that meet in the index, each once; lines of a hot key only if they meet again on the rest. Stored.

    A key of the index is one row: how many lines have it, the least and the greatest of them. These are all, or it is hot.
    """
    specs = probe_specs(limit)
    texts = lines.select("id", F.col("line").alias("text"))
    heads = _keyed(texts, index_specs(limit), limit).groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    probes = _keyed(texts, specs, limit).select("key", (F.col("id") * len(specs) + F.col("spec")).alias("p"))
    b, spec = F.call_function("div", F.col("p"), F.lit(len(specs))), F.pmod(F.col("p"), F.lit(len(specs))).cast("int")
    both = heads.hint("shuffle_hash").join(probes, "key").filter((F.col("n") > 2) | (F.col("lo") != b) | (F.col("hi") != b))
    met = stored(both.select(F.when(F.col("n") > 2, F.col("key")).alias("key"), "lo", "hi", b.alias("b"), spec.alias("spec")))
    pairs = met.filter("key is null").select(F.explode(F.array("lo", "hi")).alias("a"), "b")
    hits = met.filter("key is not null").select("key", F.col("b").alias("id"), F.col("spec").alias("hit"))
    many = hits.count()
    if many:
        pairs = pairs.union(_narrowed(texts, _small(hits, many), limit))
    return stored(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _tests(a: DataFrame, b: DataFrame) -> int:
    """Pairs of a row of a and one of b with the same g."""
    n = a.groupBy("g").count().join(b.groupBy("g").agg(F.count("*").alias("more")), "g")
    return n.agg(F.coalesce(F.sum(F.col("count").cast("double") * F.col("more")), F.lit(0.0))).first()[0]


def _narrowed(texts: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b) of hot keys whose lines meet again on the rest, and on the rest of that, for ROUNDS rounds at most.

    hits: key, id, hit (the number of the spec by which the line probes the key). A line's own segments are among them.
    """
    specs, own = probe_specs(limit), index_specs(limit)
    cut = lambda df, *more: df.select(F.col("key").alias("g"), "id", _rest("text", F.col("at"), F.col("size")).alias("text"), *more)
    b = texts.join(hits, "id").withColumn("of", F.element_at(_spec_literals(specs), F.col("hit") + 1))
    _, at, size = _segment("of", limit)
    b = b.select("key", "id", "text", at.alias("at"), size.alias("size"), F.col("of.d").alias("gap"), F.col("hit").isin([specs.index(x) for x in own]).alias("own"))
    b = stored(cut(b, "gap", "own"))
    a = b.filter("own").select("g", "id", "text")
    out = []
    for _ in range(ROUNDS):
        if _tests(a, b) <= DIRECT:
            break
        ia, ib = _keyed(a, own, limit, group="g"), _keyed(b, specs, limit, group="g", gap="gap")
        hot = _small(stored(ia.groupBy("key").count().filter(F.col("count") > HOT).select("key")))
        few = ia.select("key", F.col("id").alias("a")).join(hot, "key", "left_anti").hint("shuffle_hash")
        out.append(stored(few.join(ib.select("key", F.col("id").alias("b")), "key").select("a", "b").filter("a <> b").distinct()))
        a, b = stored(cut(ia.join(hot, "key", "left_semi"))), stored(cut(ib.join(hot, "key", "left_semi"), "gap"))
    x = a.select("g", F.col("id").alias("a"), letter_counts(F.col("text")).alias("ca"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    y = b.select("g", F.col("id").alias("b"), letter_counts(F.col("text")).alias("cb"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    out.append(x.join(y, ["g", "salt"]).filter((F.col("a") != F.col("b")) & counts_fit(F.col("ca"), F.col("cb"), limit)).select("a", "b"))
    pairs = out[0]
    for more in out[1:]:
        pairs = pairs.union(more)
    return pairs


def near_lines(lines: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Pairs (a, b) of ids of distinct lines within limit edits, each once. lines: id, line. Stored."""
    met = meeting(lines, limit)
    ids = _small(stored(met.select(F.col("a").alias("id")).union(met.select(F.col("b").alias("id"))).distinct()))
    texts = stored(lines.join(ids, "id", "left_semi").select("id", "line", letter_counts(F.col("line")).alias("c")), "zstd")
    a, b = (texts.select(F.col("id").alias(k), F.col("line").alias(f"l{k}"), F.col("c").alias(f"c{k}")) for k in "ab")
    both = met.join(a, "a").join(b, "b").filter(counts_fit(F.col("ca"), F.col("cb"), limit))
    # few bytes but much work: spread over all tasks, and stored between the steps, so that no step is worked out twice
    tasks = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.select("a", "b", "la", "lb").repartition(tasks)
    front, rests, ma, mb = differing("la", "lb")
    both = stored(both.select("*", *front).select("*", *rests).select("a", "b", ma.alias("ma"), mb.alias("mb")))
    if limit == 2:
        both = stored(both.filter(one_gap(F.col("ma"), F.col("mb"))))
    pad = F.lit("\x00" * limit)  # equal ends, so that no rest is too short for the band
    return stored(both.repartition(tasks).filter(within(F.concat("ma", pad), F.concat("mb", pad), limit)).select("a", "b"))


def sentences(lines: DataFrame) -> DataFrame:
    """id, nth, h1, h2 of each sentence of at least LEAST characters, without end mark and outer spaces, of lines (id, line)."""
    each = lines.select("id", F.posexplode(F.split(F.concat("line", F.lit(" ")), SENTENCE_END, -1)).alias("nth", "sentence"))
    each = each.filter(F.length("sentence") >= LEAST).withColumn("sentence", F.trim("sentence")).filter(F.length("sentence") >= LEAST)
    return each.select("id", "nth", *_hashes("sentence"))


def repeats(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, version, pos, nth, own of what repeats earlier text, in order of these: whole lines (nth null) and sentences.
    own: the earlier text is of the same document.

    A line goes if an earlier one equals it or is within limit edits; of the lines that stay, a sentence goes if an
    earlier sentence equals it. nth counts from 0 within the line. version tells rows of one doc_id with different
    texts apart, which are documents of their own; equal rows count as one. Rows without doc_id or text take no part.
    """
    place = ["doc_id", "version", "pos"]
    lines = placed_lines(docs)
    equal = _later(lines.select("id", *place, "h1", "h2"), place)
    first = lines.join(_small(equal.filter(F.col("id") != F.col("first.id")).select("id")), "id", "left_anti").select("id", *place, "line")
    links = near_lines(first.select("id", "line"), limit)
    where = lines.select("id", F.struct(*place).alias("place"))
    ends = _small(links).join(where.withColumnsRenamed({"id": "a", "place": "pa"}), "a").join(where.withColumnsRenamed({"id": "b", "place": "pb"}), "b")
    same = ((F.col("pa.doc_id") == F.col("pb.doc_id")) & (F.col("pa.version") == F.col("pb.version"))).alias("own")
    near = ends.select(F.when(F.col("pa") < F.col("pb"), F.struct(F.col("b").alias("id"), F.col("pb").alias("place"))).otherwise(F.struct(F.col("a").alias("id"), F.col("pa").alias("place"))).alias("x"), same)
    near = stored(near.select("x.id", "x.place.*", "own").groupBy("id", *place).agg(F.max("own").alias("own")))
    kept = sentences(first.join(_small(near.select("id")), "id", "left_anti"))
    again = _later(stored(kept), [*place, "nth"], lines.select("id", *place)).filter("repeats")
    mine = ((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.version") == F.col("version"))).alias("own")
    whole = equal.filter("repeats").select(*place, F.lit(None).cast("int").alias("nth"), mine).union(near.select(*place, F.lit(None).cast("int").alias("nth"), "own"))
    return stored(whole.union(again.select(*place, "nth", mine)).groupBy(*place, "nth").agg(F.max("own").alias("own")))


def _document(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), _version().alias("version")]


def line_report(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_lines, n_dropped, dropped (positions of lines from 0, ascending), n_cut, cut.

    cut holds line and number of each sentence that goes from a line that stays. Null text has no lines; an empty one
    has one, which is short. Long texts are treated whole, repeated rows get equal answers, other columns are ignored,
    and an empty table gives an empty result.
    """
    lines_gone = F.sort_array(F.collect_list(F.when(F.col("nth").isNull(), F.col("pos")))).alias("dropped")
    cut = F.sort_array(F.collect_list(F.when(F.col("nth").isNotNull(), F.struct("pos", "nth")))).alias("cut")
    gone = repeats(docs, limit).groupBy("doc_id", "version").agg(lines_gone, cut)
    ends = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    n = F.when(F.col("text").isNull(), 0).otherwise(ends + 1).cast("long").alias("n_lines")
    each = docs.select(*_document(docs), n).join(gone, ["doc_id", "version"], "left")
    none, no_cut = F.array().cast("array<int>"), F.array().cast("array<struct<pos:int,nth:int>>")
    dropped, cut = F.coalesce("dropped", none), F.coalesce("cut", no_cut)
    return each.select("doc_id", "n_lines", F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped"), F.size(cut).cast("long").alias("n_cut"), cut.alias("cut"))


def _bits(places: DataFrame, keys: list[str], at: str, name: str) -> DataFrame:
    """keys, and as `name` the places of column `at` as bits of an array of numbers: a place is found without a search."""
    word, bit = F.call_function("div", F.col(at), F.lit(64)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)))
    words = places.groupBy(*keys, word.alias("_word")).agg(F.bit_or(bit).alias("_bits")).groupBy(*keys)
    dense = words.agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_map"), F.max("_word").alias("_last"))
    return dense.select(*keys, F.transform(F.sequence(F.lit(0), "_last"), lambda i: F.coalesce(F.element_at("_map", i), F.lit(0).cast("long"))).alias(name))


def _marked(bits: Column, i: Column) -> Column:
    word = F.coalesce(F.get(bits, F.call_function("div", i, F.lit(64)).cast("int")), F.lit(0).cast("long"))
    return F.call_function("shiftright", word, F.pmod(i, F.lit(64))).bitwiseAND(F.lit(1)) == 1


def _left(text: Column, marks: Column) -> Column:
    """The text without what marks (whole, some: bits of lines; cuts: line, bits of sentences) says. A line that loses all sentences goes."""

    def line(x: Column, i: Column) -> Column:
        bits = F.element_at(F.filter(marks["cuts"], lambda c: c["pos"] == i), 1)["nths"]
        shorn = F.concat_ws("", F.filter(F.split(trimmed(x), SENTENCE_CUT, -1), lambda _, k: ~_marked(bits, k)))
        return F.when(_marked(marks["whole"], i), None).when(_marked(marks["some"], i), F.nullif(shorn, F.lit(""))).otherwise(x)

    return F.array_join(F.filter(F.transform(F.split(text, "\n", -1), line), lambda x: x.isNotNull()), "\n")


def without_repeats(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs with repeated lines and sentences cut out of text; all columns stay.

    A document that loses all but white space goes, and one that is a near copy of others (LEFT, COPIED); all others
    stay, null and empty ones too. Rows that repeat a
    doc_id with other texts lose only their own repeats; long texts are treated whole. An empty table gives an empty
    result. Of the texts, only the rows of docs are shuffled, and only if the marks are too many to be broadcast.
    """
    gone, document = repeats(docs, limit), ["doc_id", "version"]
    lines, parts = gone.filter("nth is null"), gone.filter("nth is not null")
    cuts = _bits(parts, [*document, "pos"], "nth", "nths").groupBy(*document).agg(F.collect_list(F.struct("pos", "nths")).alias("cuts"))
    own = gone.groupBy(*document).agg(F.max("own").alias("own"))
    marks = own.join(_bits(lines, document, "pos", "whole"), document, "left").join(_bits(parts, document, "pos", "some"), document, "left").join(cuts, document, "left")
    none = F.array().cast("array<long>")
    marks = marks.select(F.struct(*document).alias("_key"), F.struct(F.coalesce("whole", none).alias("whole"), F.coalesce("some", none).alias("some"), "cuts", "own").alias("_marks"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = docs.select(F.struct(*_document(docs)).alias("_key"), row).join(marks, "_key", "left")
    new = F.when(F.col("_marks").isNull(), F.col("_row.text")).otherwise(_left(F.col("_row.text"), F.col("_marks")))
    size = lambda t: F.length(t).cast("long")
    copy = lambda t: ~F.col("_marks.own") & (LEFT * size(t) < size("_row.text")) & (size("_row.text") - size(t) >= COPIED)
    # one value or none, so that the text is worked out once
    rows = rows.select("_row", F.explode(F.filter(F.array(new), lambda t: F.col("_marks").isNull() | (t.rlike(r"[^\s]") & ~copy(t)))).alias("_text"))
    return rows.select(*(F.col("_text").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
