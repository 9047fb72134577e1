"""Streams of trace records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(traces: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (run_id, case_id) once; redeliveries within *late* of the first are dropped."""
    timed = traces.withColumn("at", F.col("ingested_at").cast("timestamp"))
    if traces.isStreaming:
        return timed.withWatermark("at", late).dropDuplicatesWithinWatermark(["run_id", "case_id"])
    return timed.dropDuplicates(["run_id", "case_id"])


def health(traces: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, pipeline_name, n, n_errors, mean_latency_ms) per window; what comes later than *late* is dropped on a stream."""
    timed = once(traces, late)
    failed = F.coalesce(F.size("errors"), F.lit(0)) > 0
    out = timed.groupBy(F.window("at", width).alias("w"), "pipeline_name").agg(F.count("*").alias("n"), F.count(F.when(failed, 1)).alias("n_errors"), F.round(F.avg("latency_ms"), 6).alias("mean_latency_ms"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "pipeline_name", "n", "n_errors", "mean_latency_ms")
