"""Benchmark decontamination: a generalised suffix automaton of the test items, streamed over every document.

Automata are built on the driver from blocks of items of at most BLOCK_WORDS words each. Documents are streamed through
the blocks of PASS_WORDS words in one pass; a larger benchmark takes several passes, each of which adds its hits to
those of the passes before, so that no worker holds more. Only runs of words that the benchmark knows at all enter the
automaton; the others are skipped in numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakeline.llm.common import stored
from quakeline.llm.tokens import ALNUM, blocks, few_rows, lowered, split_words

WINDOW = 8
#: Words of benchmark in one automaton (of more if an item has more), and in those of one pass (about 0.6 KB a word in each worker).
BLOCK_WORDS, PASS_WORDS = 50_000, 150_000
#: Columns in which a pass leaves its hits to the next: runs of words and items.
RUNS, ITEMS = "_decontamination_runs", "_decontamination_items"


class SuffixAutomaton:
    """All substrings of the word sequences of items; windows are `window` words, or a whole shorter item."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary = np.unique(np.concatenate([w for _, w in items])) if items else np.empty(0, np.uint64)
        coded = [(name, np.searchsorted(self.vocabulary, w).tolist()) for name, w in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, word_ids in coded:
            last = 0
            for c in word_ids:
                last = self._extend(last, c)
        self.least = min([window, *(len(w) for _, w in coded)])
        self.whole: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, word_ids in coded:
            state = 0
            for i, c in enumerate(word_ids):
                state = self.next[state][c]
                if i + 1 >= window:
                    self.whole.setdefault(self._at_window(state), set()).add(name)
            if len(word_ids) < window:
                self.short.setdefault(state, []).append((len(word_ids), name))

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        link[q] = new
        return new

    def _at_window(self, state: int) -> int:
        """The state of the last `window` words of a state that is at least as long."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def stream(self, word_ids: list[int], base: int, hit: np.ndarray, names: set[str]) -> None:
        """Mark the words of every window that ends in this run and collect its items."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for i, c in enumerate(word_ids, base + 1):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            state = nxt[state].get(c, 0)
            matched = matched + 1 if state else 0
            if matched >= window:
                hit[i - window : i] = True
                names |= self.whole.get(self._at_window(state), ())
            if self.short:
                s = state
                while s > 0:
                    for n, name in self.short.get(s, ()):
                        if matched >= n:
                            hit[i - n : i] = True
                            names.add(name)
                    s = link[s]


def automata(benchmark: DataFrame, window: int = WINDOW) -> Iterator[list[SuffixAutomaton]]:
    """Automata of a benchmark (item_id, text), those of a pass together. Items without words or id are left out.

    Items come one by one in order of id, so the driver holds one pass of them.
    """
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null and text is not null").orderBy("item_id", "text")
    out, items, words, held = [], [], 0, 0
    for name, text in map(tuple, rows.toLocalIterator()):
        w = split_words(lowered([text]), ALNUM).hashes
        if not len(w):
            continue
        if items and words + len(w) > BLOCK_WORDS:
            out.append(SuffixAutomaton(items, window))
            items, words, held = [], 0, held + words
            if held + len(w) > PASS_WORDS:
                yield out
                out, held = [], 0
        items.append((name, w))
        words += len(w)
    if items:
        out.append(SuffixAutomaton(items, window))
    yield out


def scan(texts: list[str | None], found: list[SuffixAutomaton], before: list[tuple[list, list]] | None = None) -> Iterator[tuple[int, list[tuple[int, int]], list[tuple[int, int]], set[str]]]:
    """Of each text: words, byte spans of hit runs, the same in words, names of items. before: runs and names of earlier passes."""
    raw = lowered(texts)
    for part in blocks(raw):
        w = split_words(raw[part], ALNUM)
        hits = np.zeros(len(w.hashes), bool)
        names: dict[int, set[str]] = {}
        for k, (old, known) in enumerate(before[part] if before else ()):
            for lo, hi in old:
                hits[w.at[k] + lo : w.at[k] + hi] = True
            if known:
                names[k] = set(known)
        for a in found:
            code = np.searchsorted(a.vocabulary, w.hashes)
            code[code == len(a.vocabulary)] = 0
            known = a.vocabulary[code] == w.hashes
            # a run never crosses from one text to the next
            edges = np.zeros(len(known) + 1, bool)
            edges[1:-1] = known[1:] != known[:-1]
            edges[w.at] = edges[0] = edges[-1] = True
            cut = np.flatnonzero(edges)
            long = (np.diff(cut) >= a.least) & known[cut[:-1]]
            for lo, hi in zip(cut[:-1][long].tolist(), cut[1:][long].tolist(), strict=True):
                own = names.setdefault(int(np.searchsorted(w.at, lo, "right")) - 1, set())
                a.stream(code[lo:hi].tolist(), lo, hits, own)
        edges = np.zeros(len(hits) + 1, bool)
        edges[1:-1] = hits[1:] != hits[:-1]
        edges[w.at] = edges[0] = edges[-1] = True
        cut = np.flatnonzero(edges)
        runs = [(lo, hi) for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if hits[lo]]
        spans: dict[int, list[tuple[int, int]]] = {}
        for lo, hi in runs:
            k = int(np.searchsorted(w.at, lo, "right")) - 1
            spans.setdefault(k, []).append((lo, hi))
        for k in range(part.stop - part.start):
            own = spans.get(k, [])
            off, head = int(w.offsets[k]), int(w.at[k])
            yield int(w.at[k + 1]) - head, [(int(w.start[lo]) - off, int(w.end[hi - 1]) - off) for lo, hi in own], [(lo - head, hi - head) for lo, hi in own], names.get(k, set())


def _before(batch: pa.RecordBatch) -> list[tuple[list, list]] | None:
    if RUNS not in batch.schema.names:
        return None
    runs = [[(x["lo"], x["hi"]) for x in r] for r in batch.column(RUNS).to_pylist()]
    return list(zip(runs, batch.column(ITEMS).to_pylist(), strict=True))


def _n(runs: list[tuple[int, int]]) -> int:
    return sum(hi - lo for lo, hi in runs)


def _adds(found: list[SuffixAutomaton], at: int) -> Callable:
    """A pass that is not the last: the rows as they are, with all hits so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            rows = list(scan(batch.column(at).to_pylist(), found, _before(batch)))
            runs = pa.array([[{"lo": lo, "hi": hi} for lo, hi in r[2]] for r in rows], pa.list_(pa.struct({"lo": pa.int32(), "hi": pa.int32()})))
            items = pa.array([sorted(r[3]) for r in rows], pa.list_(pa.string()))
            own = [k for k, n in enumerate(batch.schema.names) if n not in (RUNS, ITEMS)]
            yield pa.record_batch([*(batch.column(k) for k in own), runs, items], [*(batch.schema.names[k] for k in own), RUNS, ITEMS])

    return run


def _passes(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, list[SuffixAutomaton]]:
    """docs with the hits of all passes but the last, and the automata of the last."""
    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema]
    runs = T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))
    schema = T.StructType([*fields, T.StructField(RUNS, runs), T.StructField(ITEMS, T.ArrayType(T.StringType()))])
    held: list[SuffixAutomaton] | None = None
    for found in automata(benchmark, window):
        if held is not None:
            docs = stored(docs.mapInArrow(_adds(held, docs.columns.index("text")), schema), "zstd")
        held = found
    return docs, held or []


def _reports(found: list[SuffixAutomaton]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            rows = list(scan(batch.column(1).to_pylist(), found, _before(batch)))
            yield pa.record_batch(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([_n(r[2]) for r in rows], pa.int64()), pa.array([len(r[3]) for r in rows], pa.int64()), pa.array([hashlib.sha256(",".join(sorted(r[3])).encode()).hexdigest() for r in rows], pa.string())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"],
            )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = 2) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit inside any occurrence of `window` consecutive item words, or of a whole shorter item. Null and
    empty texts have no words; an empty benchmark hits nothing; repeated rows and items are answered alike. Long texts
    are read whole, other columns don't matter, and an empty table gives an empty result.
    """
    rows, found = _passes(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, window)
    out = rows.mapInArrow(_reports(found), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    return out.withColumn("contaminated", F.col("n_items") >= min_items)


def _cleaner(found: list[SuffixAutomaton], at: int, coverage: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            texts, keep = batch.column(at).to_pylist(), []
            for i, (n, spans, runs, _) in enumerate(scan(texts, found, _before(batch))):
                keep.append(not runs or _n(runs) < coverage * n)
                if runs and keep[-1]:
                    raw, last, parts = texts[i].encode("utf-8", "surrogatepass"), 0, []
                    for lo, hi in spans:
                        parts.append(raw[last:lo])
                        last = hi
                    texts[i] = b"".join([*parts, raw[last:]]).decode("utf-8", "surrogatepass")
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            own = [k for k, n in enumerate(batch.schema.names) if n not in (RUNS, ITEMS)]
            yield pa.record_batch([columns[k] for k in own], [batch.schema.names[k] for k in own]).filter(pa.array(keep, pa.bool_()))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """docs without benchmark passages: spans of hit words are cut out of text; documents hit to `coverage` go.

    All columns come back; only text changes, and only where there was a span. Null and empty texts stay, rows may
    repeat, and an empty table gives an empty result.
    """
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    docs, found = _passes(docs, benchmark, window)
    return docs.mapInArrow(_cleaner(found, docs.columns.index("text"), coverage), schema)
