"""Near-duplicate documents: min-max hashing for candidates, full shingle sets for the decision.

1. One pass over the texts gives each document's shingle count, a 128-bit fingerprint of its set and the keys of
   its bands. Every permutation is evaluated once and yields two signature values, the minimum and the maximum.
2. Documents with equal sets are one class; the least id stands for it from here on.
3. Within every band bucket the least id is the leader; each other member is compared with it on full sets. The
   leader is a pre-aggregated minimum, so a bucket of any size is never gathered.
4. Buckets whose members are not yet all in one component may hide further links. Their documents, and only
   these, go through an exact prefix filter: two sets with similarity t share one of the first n - ceil(t n) + 1
   elements in rarest-first order. Candidates lie in different components, so a dense group makes no pairs.
5. Confirmed links are contracted to components.

A pair at the threshold shares no band with probability (1 - 0.75^5)^60 = 9e-8; more similar pairs less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quakeline.llm.common import stored
from quakeline.llm.components import components
from quakeline.llm.shingles import shingle_sets
from quakeline.llm.tokens import few_rows, mix

BANDS, ROWS = 60, 5
#: Candidate ids up to this many (8 bytes each) are broadcast to the scan of the texts; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000
#: An element of more documents than this is dealt into SALTS parts.
HOT, SALTS = 200, 16
_SIGNATURE = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"


def min_max_bands(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band keys of non-empty sets, one row each: bands * rows signature values from half as many permutations."""
    half = -(-bands * rows // 2)
    rng = np.random.default_rng(11)
    times = rng.integers(0, 2**31, half, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    flip = rng.integers(0, 2**32, half, dtype=np.uint32)
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    values = np.empty((len(sets), 2 * half), np.uint64)
    for p in range(half):
        v = (flat ^ flip[p]) * times[p]
        values[:, p] = np.minimum.reduceat(v, at)
        values[:, half + p] = np.maximum.reduceat(v, at)
    values = mix(values[:, : bands * rows] + np.arange(bands * rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mix(values.reshape(len(sets), bands, rows).sum(axis=2, dtype=np.uint64))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in few_rows(batches):
        ids = batch.column(0)
        for part, sets in shingle_sets(batch.column(1).to_pylist()):
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            full = [s for s in sets if len(s)]
            f = np.zeros((2, len(sets)), np.uint64)
            keys = np.empty((0, BANDS), np.uint64)
            if full:
                flat, at = np.concatenate(full), np.concatenate(([0], np.cumsum([len(s) for s in full])[:-1]))
                f[0, n > 0], f[1, n > 0] = np.add.reduceat(mix(flat, 1), at), np.add.reduceat(mix(flat, 2), at)
                keys = min_max_bands(full)
            offsets = np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.record_batch([ids[part], pa.array(n), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), lists], ["doc_id", "n_shingles", "f1", "f2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in few_rows(batches):
        for part, sets in shingle_sets(batch.column(1).to_pylist()):
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.record_batch([batch.column(0)[part], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "shingles"])


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Full sets of the documents named by ids (doc_id, distinct)."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return stored(texts.join(ids, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles array<long>").dropDuplicates(["doc_id"]))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""
    a, b = (sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(b, "b").join(a, "a").filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _prefix_candidates(sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that can reach the similarity, by the prefix filter with sizes and positions."""
    each = sets.select("doc_id", F.size("shingles").alias("n"), F.explode("shingles").alias("x"))
    found = each.groupBy("x").agg(F.count("*").alias("df"))
    order = W.partitionBy("doc_id").orderBy("df", "x")
    heads = each.join(found, "x").withColumn("i", F.row_number().over(order)).filter(F.col("i") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    heads = stored(heads.filter("df > 1").join(roots, "doc_id").select("x", "doc_id", "n", "i", "root"))
    # the rows of an element that many documents share are dealt into SALTS parts, each of which meets all of its partners
    hot = stored(heads.groupBy("x").count().filter(F.col("count") > HOT).select("x", F.lit(True).alias("hot")))
    heads = heads.join(F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot, "x", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    parts = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    heads = heads.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(0))
    # Of a shared element, only documents outside its largest component look for partners: inside one there is nothing to find.
    most = heads.groupBy("x", "hot", "root").agg(F.count("*").alias("k")).groupBy("x", "hot").agg(F.max_by("root", F.struct("k", "root")).alias("top"), F.count("*").alias("roots")).filter("roots > 1")
    rest = heads.join(most.select("x", "top", parts), ["x", "salt"]).filter("root <> top").select("x", parts, *(F.col(c).alias(f"{c}_") for c in ("doc_id", "n", "i", "root")))
    fits = (100 * F.least("n", "n_") >= percent * F.greatest("n", "n_")) & ((100 + percent) * (1 + F.least(F.col("n") - F.col("i"), F.col("n_") - F.col("i_"))) >= percent * (F.col("n") + F.col("n_")))
    pairs = heads.join(rest, (heads["x"] == rest["x"]) & (heads["salt"] == rest["salt"]) & (F.col("root") != F.col("root_")) & fits)
    return pairs.select(F.least("doc_id", "doc_id_").alias("a"), F.greatest("doc_id", "doc_id_").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    component_id is the least doc_id reachable over links, kept tells doc_id = component_id. Texts without words or
    null link with nothing. Rows repeating a doc_id count as one document and each gets its answer; rows without
    doc_id have a null component and are kept. Other columns are ignored. An empty table gives an empty result. Words
    and shingles are 64-bit hashes, and sets are equal if their sizes and 128-bit sums are. A long text is one value.
    """
    signed = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sign, _SIGNATURE))
    named = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    reps = classes.select(F.col("rep").alias("doc_id"))
    keys = named.join(reps, "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("key", "leader")
    members = stored(keys.join(shared, "key").select("key", "leader", "doc_id").distinct())
    star = stored(members.filter("leader <> doc_id").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct())
    sets = _sets_of(docs, members.select("doc_id").distinct())
    links = stored(_confirmed(star, sets, percent))  # a < b
    # a label that any link supports serves to leave out pairs; what it leaves apart is only compared once more
    first = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    second = first.select(F.col("node").alias("root"), F.col("root").alias("top"))
    roots = first.join(second, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    placed = members.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    open_ = stored(placed.join(split, "key", "left_semi").select("doc_id", "root").distinct())
    pairs = _prefix_candidates(sets.join(open_.select("doc_id"), "doc_id", "left_semi"), open_, percent)
    more = _confirmed(pairs, sets, percent)
    roots = components(links.union(more))
    named_roots = classes.join(roots, classes["rep"] == roots["node"], "left").select("f1", "f2", "n_shingles", F.coalesce("root", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "f1", "f2").join(named_roots, ["f1", "f2", "n_shingles"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
