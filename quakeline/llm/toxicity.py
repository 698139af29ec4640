"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words of the whole text are hashed into an embedding table, each word by itself and by its first letters, so that
inflected forms share a part; buckets seen in fewer than LEAST_TEXTS of the texts learned from stay zero. Filters of widths 1 to 3 slide over them, each keeps its
maximum over the document, and a logistic unit reads the maxima. The model is fitted on a bounded sample of labelled
rows (SAMPLE), its score is calibrated on rows it has not seen so that 0.5 is the best cut for F1, and a threshold for
each language is chosen there too. Only the text enters a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeline.llm.common import stored
from quakeline.llm.tokens import ALNUM, blocks, few_rows, mix, split_words

BUCKETS, WIDTH, FILTERS, WIDTHS = 1 << 18, 12, 8, (1, 2, 3)
#: Bytes of the beginning of a word, and texts that must have a bucket.
PREFIX, LEAST_TEXTS = 5, 4
#: Labelled rows learned from at most, of each class; of these a quarter calibrates.
SAMPLE = 4_000
#: Hashed words of the rows learned from, together: what the driver holds of them.
SAMPLE_BYTES = 64 << 20
EPOCHS, BATCH, RATE = 6, 48, 0.08
#: Toxic rows of a language needed for a threshold of its own.
LEAST_TOXIC = 25
SCORE_BYTES = 1 << 17


def word_ids(texts: list[str | None]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For runs of texts: two buckets of each word (whole, beginning) as rows, and where each text starts.

    Words are runs of digits, letters a-z after lower-casing and all other alphabets.
    """
    raw = [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    for part in blocks(raw, SCORE_BYTES):
        w = split_words(raw[part], ALNUM)
        data = np.frombuffer(w.data + b" " * PREFIX, np.uint8)
        head = np.zeros(len(w.start), np.uint64)
        for k in range(PREFIX):
            head = (head << np.uint64(8)) | np.where(w.start + k < w.end, data[w.start + k], 0).astype(np.uint64)
        both = np.stack((w.hashes, mix(head, 99)), axis=1)
        yield part, (both >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32), w.at


@dataclass
class Model:
    """Embeddings, filters by width and offset, and the logistic unit; scores are calibrated by slope and cut."""

    embedding: np.ndarray
    kernels: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    cut: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    keep: np.ndarray = field(default_factory=lambda: np.ones(BUCKETS + 1, bool))

    @classmethod
    def fresh(cls) -> Model:
        rng = np.random.default_rng(3)
        n = FILTERS * len(WIDTHS)
        embedding = rng.normal(0, 0.1, (BUCKETS + 1, WIDTH)).astype(np.float32)
        embedding[BUCKETS] = 0
        return cls(
            embedding, [rng.normal(0, 0.3 / np.sqrt(w), (w, WIDTH, FILTERS)).astype(np.float32) for w in WIDTHS],
            np.zeros(n, np.float32), rng.normal(0, 0.3, n).astype(np.float32), 0.0,
        )

    def pooled(self, ids: np.ndarray, at: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Maxima of every filter over each text (0 at least), and where they lie. The last bucket pads.

        A filter that starts on padding has nothing to read, so it gives 0 there, whatever text comes next.
        """
        n, last = len(at) - 1, max(WIDTHS) - 1
        lengths = np.diff(at) + last
        heads = np.concatenate(([0], np.cumsum(lengths)))
        padded = np.full((int(heads[-1]), 2), BUCKETS, np.int32)
        padded[np.arange(len(ids)) + np.repeat(np.arange(n) * last, np.diff(at))] = np.where(self.keep[ids], ids, BUCKETS)
        pads = (heads[1:, None] - 1 - np.arange(last)).ravel()
        x = self.embedding[padded[:, 0]] + self.embedding[padded[:, 1]]
        best, where = np.zeros((n, FILTERS * len(WIDTHS)), np.float32), None
        if places:
            where = np.full(best.shape, -1, np.int64)
        for k, (w, kernel) in enumerate(zip(WIDTHS, self.kernels, strict=True)):
            conv = x @ kernel[0]
            for j in range(1, w):
                conv[: len(x) - j] += x[j:] @ kernel[j]
            conv[pads] = 0
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            best[:, own] = np.maximum.reduceat(conv, heads[:-1], axis=0)
            if places:
                for i in range(n):
                    where[i, own] = heads[i] + conv[heads[i] : heads[i + 1]].argmax(axis=0)
        best += self.bias
        if places:
            where[np.isin(where, pads)] = len(padded)  # past the end, where only padding is met
            where[best <= 0] = -1
            self._padded = padded
        return np.maximum(best, 0), where

    def logits(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        # row by row, so that the sum of a text does not hang on its place in the batch
        return (self.pooled(ids, at)[0] * self.out).sum(axis=1) + self.out_bias

    def score(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (logits.astype(np.float64) - self.cut), -30, 30)))

    def fit(self, docs: list[np.ndarray], labels: np.ndarray) -> None:
        """Adagrad on the cross entropy with both classes weighted alike; only the words at maxima get gradients."""
        rng = np.random.default_rng(5)
        texts = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=BUCKETS + 1)
        self.keep = texts >= LEAST_TEXTS
        self.embedding[BUCKETS] = 0
        weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, len(labels) - labels.sum())) * len(labels)
        seen = {k: np.full_like(v, 1e-3) for k, v in (("embedding", self.embedding), ("bias", self.bias), ("out", self.out))} | {k: np.full_like(v, 1e-3) for k, v in enumerate(self.kernels)}

        def step(name: object, value: np.ndarray, grad: np.ndarray, rows: object = slice(None)) -> None:
            seen[name][rows] += grad * grad
            value[rows] -= RATE * grad / np.sqrt(seen[name][rows])

        for _ in range(EPOCHS):
            order = rng.permutation(len(docs))
            for lo in range(0, len(order), BATCH):
                own = order[lo : lo + BATCH]
                part = [docs[i] for i in own]
                best, where = self.pooled(np.concatenate(part), np.concatenate(([0], np.cumsum([len(d) for d in part]))), True)
                error = (1 / (1 + np.exp(-np.clip(best @ self.out + self.out_bias, -30, 30))) - labels[own]) * weight[own] / len(own)
                error = error.astype(np.float32)
                back = error[:, None] * self.out
                back[where < 0] = 0
                touched, grads = [], []
                for k, kernel in enumerate(self.kernels):
                    i, f = np.nonzero(where[:, k * FILTERS : (k + 1) * FILTERS] >= 0)
                    place, g = where[i, k * FILTERS + f], back[i, k * FILTERS + f][:, None]
                    grad = np.zeros_like(kernel)
                    for j in range(len(kernel)):
                        words = self._padded[np.minimum(place + j, len(self._padded) - 1)]
                        np.add.at(grad[j].T, f, g * (self.embedding[words[:, 0]] + self.embedding[words[:, 1]]))
                        touched += [words[:, 0], words[:, 1]]
                        grads += [g * kernel[j].T[f]] * 2
                    step(k, kernel, grad)
                rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
                grad = np.zeros((len(rows), WIDTH), np.float32)
                np.add.at(grad, inverse, np.concatenate(grads))
                grad[rows == BUCKETS] = 0
                step("embedding", self.embedding, grad, rows)
                step("bias", self.bias, back.sum(axis=0))
                step("out", self.out, error @ best)
                self.out_bias -= 0.05 * float(error.sum())
        self._padded = None

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, langs: list[str | None]) -> None:
        """Put the cut where F1 is best, and learn a threshold of the score for each language with enough toxic rows."""
        self.cut = best_cut(logits, labels)
        spread = float(np.std(logits)) or 1.0
        self.slope = 2.0 / spread
        scores = self.score(logits)
        for lang in sorted({x for x in langs if x is not None}):
            own = np.array([x == lang for x in langs])
            if labels[own].sum() >= LEAST_TOXIC:
                self.thresholds[lang] = best_cut(scores[own], labels[own])


def best_cut(values: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the best F1 for values at or above it, in the middle of its gap."""
    order = np.argsort(-values, kind="stable")
    v, hit = values[order].astype(np.float64), np.cumsum(labels[order])
    f1 = 2 * hit / (np.arange(1, len(v) + 1) + max(1, labels.sum()))
    f1[:-1][v[1:] == v[:-1]] = -1
    if not len(v):
        return 0.0
    k = int(f1.argmax())
    return float((v[k] + v[k + 1]) / 2) if k + 1 < len(v) else float(v[k])


def held_out() -> Column:
    """Rows that are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in few_rows(batches):
        out: list[bytes] = []
        for _, ids, at in word_ids(batch.column("text").to_pylist()):
            out += [ids[a:b].astype("<i4").tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.record_batch([batch.column("doc_id"), batch.column("lang"), batch.column("toxic"), pa.array(out, pa.binary())], ["doc_id", "lang", "toxic", "words"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit and calibrate on at most `sample` rows of each class, the first by a hash of doc_id, never on held-out ones.

    Of these rows, in the same order, those are learned from whose hashed words (8 bytes each) fit into sample_bytes.
    A doc_id with clashing labels is toxic; of several texts of a doc_id the least by its hashed words counts. Without rows of both classes the model stays as it is at first, with scores below 0.5.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out())
    order = F.xxhash64("doc_id")
    chosen = [known.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(sample) for c in (0, 1)]
    chosen = F.broadcast(chosen[0].union(chosen[1]))  # two times `sample` rows at most
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string")).join(chosen, "doc_id")
    hashed = texts.mapInArrow(_hashed, "doc_id long, lang string, toxic int, words binary")
    hashed = stored(hashed.groupBy("doc_id").agg(F.min(F.struct("words", "lang", "toxic")).alias("r")).select("doc_id", "r.*"))
    sizes = hashed.select("doc_id", F.length("words"), F.xxhash64("doc_id")).collect()
    within, picked = sample_bytes, []
    for doc_id, size, _ in sorted(sizes, key=lambda r: (r[2], r[0])):
        if size <= within:
            picked.append(doc_id)
            within -= size
    rows = sorted(hashed.filter(F.col("doc_id").isin(picked) if len(picked) < len(sizes) else F.lit(True)).collect(), key=lambda r: r.doc_id)
    model = Model.fresh()
    words = [np.frombuffer(r.words, "<i4").reshape(-1, 2) for r in rows]
    truth = np.array([r.toxic for r in rows], np.int64)
    if len(set(truth.tolist())) < 2:
        model.cut = np.inf
        return model
    aside = np.arange(len(rows)) % 4 == 3
    if truth[aside].sum() < 4:
        aside = np.zeros(len(rows), bool)
    model.fit([w for w, x in zip(words, aside, strict=True) if not x], truth[~aside])
    own = aside if aside.any() else ~aside
    part = [w for w, x in zip(words, own, strict=True) if x]
    logits = np.concatenate([model.logits(np.concatenate(part[i : i + 64]), np.concatenate(([0], np.cumsum([len(w) for w in part[i : i + 64]])))) for i in range(0, len(part), 64)])
    model.calibrate(logits, truth[own], [r.lang for r, x in zip(rows, own, strict=True) if x])
    return model


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    """Score of each whole text; empty and null texts have the score of no words."""
    out = np.zeros(len(texts))
    for part, ids, at in word_ids(texts):
        out[part] = model.score(model.logits(ids, at))
    return out


def _scorer(model: Model, at: int, lang: int | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            score = scores(model, batch.column(at).to_pylist())
            if lang is None:
                yield pa.record_batch([batch.column(0), pa.array(score)], ["doc_id", "score"])
            else:
                cut = np.array([model.thresholds.get(x, 0.5) for x in batch.column(lang).to_pylist()])
                yield batch.filter(pa.array(score < cut))

    return run


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score, predicted.

    Null texts count as empty. Rows may repeat and get equal answers; long texts are read whole; other columns don't
    matter, and an empty table gives an empty result. Rows without doc_id are not held out.
    """
    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scorer(model, 1, None), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs (text, lang and any others) whose score is below the threshold of their language.

    A language without a threshold, or null, takes 0.5. Null and empty texts have the score of no words. Rows come back
    as they are, repeated ones each; an empty table gives an empty result.
    """
    return docs.mapInArrow(_scorer(model, docs.columns.index("text"), docs.columns.index("lang")), docs.schema)
