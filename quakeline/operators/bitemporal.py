"""Bitemporal operators: version diffs, what was known when, and which source wins."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Facts of one class this close in time are told apart by their source, not by date.
SAME_PERIOD_DAYS = 90
#: Rows of a batch that ranked keys go back in.
BATCH_ROWS = 10_000


def known_at(day: str | Column) -> Column:
    """Recorded by the end of the day and not yet superseded then."""
    cut = F.date_add(F.lit(day).cast("date") if isinstance(day, str) else day, 1)
    return (F.col("recorded_at") < cut) & (F.col("superseded_at").isNull() | (F.col("superseded_at") >= cut))


def valid_at(day: str | Column) -> Column:
    """valid_from is included, valid_to is not; null is open."""
    at = F.lit(day).cast("date") if isinstance(day, str) else day
    return (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))


def content_hash(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def version_diff(current: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """keys, old_hash, new_hash, inserted, superseded, unchanged. Both sides have a column hash; a change counts as both."""
    old = current.select(*keys, F.col("hash").alias("old_hash"))
    both = old.join(new.select(*keys, F.col("hash").alias("new_hash")), list(keys), "full_outer")
    same = F.col("old_hash").eqNullSafe(F.col("new_hash"))
    return both.withColumns({"inserted": F.col("new_hash").isNotNull() & ~same, "superseded": F.col("old_hash").isNotNull() & ~same, "unchanged": same})


def apply_versions(store: DataFrame, new: DataFrame, keys: list[str], recorded_at: str) -> DataFrame:
    """The store after a load: open rows that changed or vanished are closed, new and changed rows are appended.

    store: keys, hash, payload columns, recorded_at, superseded_at; new has the same without the last two.
    """
    stamp = F.lit(recorded_at).cast("timestamp")
    open_ = store.filter("superseded_at is null")
    same = open_.join(new.select(*keys, F.col("hash")), [*keys, "hash"], "left_semi").select(*keys, "hash").withColumn("_same", F.lit(True))
    closed = store.join(same, [*keys, "hash"], "left").withColumn("superseded_at", F.when(F.col("superseded_at").isNull() & F.col("_same").isNull(), stamp).otherwise(F.col("superseded_at"))).drop("_same")
    added = new.join(same.select(*keys, "hash"), [*keys, "hash"], "left_anti").withColumns({"recorded_at": stamp, "superseded_at": F.lit(None).cast("timestamp")})
    return closed.unionByName(added)


def load_source(store: DataFrame, new: DataFrame, keys: list[str], recorded_at: str, source: str, problems: DataFrame | None = None) -> DataFrame:
    """The store after one source was read again: its rows are versioned, all other sources stay as they are.

    With problems (rule, ...) of errors among them the load is refused as a whole. Both tables have a column source.
    """
    if problems is not None:
        errors = [r.rule for r in problems.filter(F.col("rule").startswith("E")).select("rule").distinct().orderBy("rule").limit(20).collect()]
        if errors:
            raise ValueError(f"the load breaks {', '.join(errors)}; nothing was loaded")
    own = F.col("source") == source
    return store.filter(~own).unionByName(apply_versions(store.filter(own), new.filter(own), keys, recorded_at))


def latest(rows: DataFrame, keys: list[str], *newest_first: Column) -> DataFrame:
    """One row per key: the first in the given order, which must end in a unique column."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*newest_first))).filter("_n = 1").drop("_n")


def latest_query(rows: DataFrame) -> DataFrame:
    """Rows of the query hash that was recorded last for their key. rows: key, query_hash, recorded_on, row_id."""
    last = rows.groupBy("key").agg(F.max_by("query_hash", F.struct("recorded_on", "row_id")).alias("query_hash"))
    return rows.join(last, ["key", "query_hash"], "left_semi")


def series(rows: DataFrame) -> DataFrame:
    """The series as known: the latest query of each key, the latest version of each day."""
    return latest(latest_query(rows), ["key", "day"], F.desc("recorded_on"), F.desc("row_id"))


def winners(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The winning row of each key. rows: keys, trusted, weight_source, valid_from, source_order, row_id.

    Trusted before others, sourced numbers before buckets; of the best class what is within SAME_PERIOD_DAYS of its
    newest; of these the first source, then the newest.
    """
    whole = W.partitionBy(*keys)
    cls = F.when(F.col("trusted"), 0).otherwise(2) + F.when(F.col("weight_source") == "bucket", 1).otherwise(0)
    ranked = rows.withColumn("_class", cls).withColumn("_best", F.min("_class").over(whole)).filter("_class = _best")
    near = ranked.withColumn("_newest", F.max("valid_from").over(whole)).filter(F.datediff("_newest", "valid_from") <= SAME_PERIOD_DAYS)
    return latest(near, keys, F.asc("source_order"), F.desc("valid_from"), F.desc("row_id")).drop("_class", "_best", "_newest")


def _ranked_class(days: list[int], order: list[tuple], n: int) -> list[int]:
    """Places of the rows of one class, which come newest first. A heap holds those within reach of the newest one left."""
    if len(days) == 1:
        return [n]
    place, heap, taken, newest, ahead = [0] * len(days), [], [False] * len(days), 0, 0
    for rank in range(n, n + len(days)):
        while taken[newest]:
            newest += 1
        while ahead < len(days) and days[newest] - days[ahead] <= SAME_PERIOD_DAYS:
            heapq.heappush(heap, (order[ahead], ahead))
            ahead += 1
        first = heapq.heappop(heap)[1]
        taken[first], place[first] = True, rank
    return place


def _ranked_keys(table: pa.Table, schema: pa.Schema) -> list[pa.RecordBatch]:
    """Rows of whole keys, each in order of class and day, with their places. _n counts the rows of a key from 1."""
    ns, cls, days, first = (table[c].to_numpy().tolist() for c in ("_n", "_class", "_day", "_order"))
    starts = [i for i, n in enumerate(ns) if n == 1 or cls[i] != cls[i - 1]] + [len(ns)]
    places: list[int] = []
    for lo, hi in zip(starts, starts[1:], strict=False):
        own = days[lo:hi]
        places += _ranked_class(own, [(s, -d) for s, d in zip(first[lo:hi], own, strict=True)], ns[lo])
    out = table.drop_columns(["_n", "_class", "_day", "_order"]).append_column("rank_in_key", pa.array(places, pa.int32()))
    return out.cast(schema).combine_chunks().to_batches(max_chunksize=BATCH_ROWS)


def precedence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of each key with rank_in_key, the winner first, then the winner of what is left, and so on.

    Classes follow each other. Within a class the reach of 90 days moves on with the newest row left, so a sweep over
    the days with a heap ranks n rows in n log n steps. Spark sorts the keys; a batch of many keys goes through Python
    at once, and a key that runs on into the next batch waits for its end. rows should have no columns but those needed.
    """
    cls = F.when(F.col("trusted"), 0).otherwise(2) + F.when(F.col("weight_source") == "bucket", 1).otherwise(0)
    order = W.partitionBy(*keys).orderBy("_class", F.desc("_day"), F.desc("row_id"))
    # a missing source_order comes first, as among winners; a missing day comes last
    placed = rows.withColumns({"_class": cls, "_day": F.coalesce(F.unix_date(F.col("valid_from").cast("date")), F.lit(-(1 << 30))), "_order": F.coalesce(F.col("source_order").cast("long"), F.lit(-(1 << 63)))})
    placed = placed.withColumn("_n", F.row_number().over(order))
    fields = T.StructType([*rows.schema, T.StructField("rank_in_key", T.IntegerType())])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("_n").to_numpy(zero_copy_only=False) == 1)
            if len(starts):
                cut = int(starts[-1])
                done = pa.Table.from_batches([*held, batch.slice(0, cut)])
                if done.num_rows:
                    yield from _ranked_keys(done, _without(batch.schema))
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield from _ranked_keys(pa.Table.from_batches(held), _without(held[0].schema))

    return placed.mapInArrow(rank, fields)


def _without(schema: pa.Schema) -> pa.Schema:
    return pa.schema([*(f for f in schema if f.name not in ("_n", "_class", "_day", "_order")), pa.field("rank_in_key", pa.int32())])


def snapshot(edges: DataFrame, as_of: str, known: str | None = None) -> DataFrame:
    """Winning edge of each (src, rel, dst) valid on as_of, as known then or on another day."""
    return winners(edges.filter(known_at(known or as_of) & valid_at(as_of)), ["src", "rel", "dst"])


def winner_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys whose winning source differs between two snapshots."""
    keys = ["src", "rel", "dst"]
    both = before.select(*keys, F.col("source").alias("old_source")).join(after.select(*keys, F.col("source").alias("new_source")), keys)
    return both.filter("old_source <> new_source")
