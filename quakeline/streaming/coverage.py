"""Streaming ingestion of coverage: late and revised rows become new versions, windows close behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COVERAGE = "kind string, key string, day date, matched bigint, norm bigint, tone double, query_hash string"
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def coverage_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(COVERAGE).json(folder)


def append_versions(stream: DataFrame, table: str, checkpoint: str):  # noqa: ANN201
    """Append each batch with its time as a new version; nothing is updated, so old knowledge stays readable.

    The name of a batch's folder is its number: a batch that is tried again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumns({"recorded_at": F.current_timestamp(), "row_id": F.concat_ws("-", F.lit(f"{number:012d}"), "key", "day")})
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """key, window, matched, norm-ready counts: one row per key and window once the watermark has passed it."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, F.col("event_type").alias("key")).agg(F.count("*").alias("matched"), F.avg("value").alias("tone")).select("key", F.col("window.start").alias("start"), "matched", "tone")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Stretches of a user's events without a longer gap: the streaming form of consecutive days."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def held_until(held: DataFrame, wanted_to: str, slack_days: int) -> DataFrame:
    """Series (key, last) that need no further fetch: they reach wanted_to less the slack."""
    return held.filter(F.col("last") >= F.date_sub(F.lit(wanted_to).cast("date"), slack_days))
