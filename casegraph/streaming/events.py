"""Structured Streaming over event tables: windows of shared activity, sessions, snapshots (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_activity(events: DataFrame, minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, users, total) of tumbling windows of events (ts, user_id, event_type, value); on a stream, rows later than
    `late` are dropped and a window's state with them. Users are counted approximately, in bounded state."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    sums = rows.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type")
    out = sums.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "users", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of runs of a user's events with no gap of that length."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def each_batch(stream: DataFrame, checkpoint: str, act: Callable[[DataFrame, int], None]):
    """Run act over every micro-batch that is there, then stop; the checkpoint makes a restart go on where it ended."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(act).start()
