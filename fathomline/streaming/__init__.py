"""Event streams: the same functions serve batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watermarked(events: DataFrame, late: str | None) -> DataFrame:
    """``ts`` as a timestamp; on a stream, rows later than ``late`` behind the latest one seen are dropped by the aggregates that follow."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late) if late else events


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Count and total by event type and window: tumbling, or sliding where ``slide`` is given."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return watermarked(events, late).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total")).select(
        F.col("window.start").alias("start"), "event_type", "n", "total")


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    return windowed(events, "1 hour", late=late)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Count and total of each user's sessions, which end after ``gap`` without an event."""
    return watermarked(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total")).select(
        "user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def first_seen(events: DataFrame, key: str, late: str | None = None) -> DataFrame:
    """Each key once: on a stream, repeats within the watermark are dropped."""
    events = watermarked(events, late)
    return events.dropDuplicatesWithinWatermark([key]) if events.isStreaming and late else events.dropDuplicates([key])
