"""Event-time windows and streaming journals: an extension that also runs on batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.functions.numeric import round_to


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts and sums by type and hour; on a stream, rows later than ``late`` are dropped by the watermark."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), round_to(F.sum("value"), 2).alias("total"))
    return grouped.select("event_type", F.col("w.start").alias("hour"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: bursts of events with no gap of ``gap``."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def journal_once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Journal events with repeated deliveries removed: exactly-once into a file sink with a checkpoint."""
    keys = ["candidate_id", "event"]
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def append(stream: DataFrame, path: str, checkpoint: str):
    """Start an append query into JSON files that ends when all available rows are written."""
    return stream.writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
