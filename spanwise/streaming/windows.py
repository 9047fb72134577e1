"""Windowed aggregates that read the same from a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total) per hour and type.  On a stream, rows later than *late* are dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", late)
    out = timed.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")
