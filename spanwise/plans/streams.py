"""Streams over the tables, worked off once; each agrees with its batch counterpart."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import scratch_dir, table
from ..streaming.drain import drain
from ..streaming.references import follow_references, read_state
from ..streaming.windows import hourly
from .evaluation_sql import ORACLES as EVALUATION
from .references import _FOUND, _events


def _stream(spark: SparkSession, df: DataFrame, name: str, files: int = 0) -> DataFrame:
    """A file stream of what *df* holds: a folder of its own in the shared folder.  With *files*, so many, one a micro-batch."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if files:
        df.repartition(files, F.xxhash64(*df.columns)).write.parquet(path)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    return drain(hourly(_stream(spark, table(spark, d, "events"), "events")), "complete")


def stream_references(spark: SparkSession, d: str) -> DataFrame:
    """The references that wait after a stream of all events, which come in four micro-batches and in no order."""
    folder = f"{scratch_dir(spark)}/references-{uuid.uuid4().hex}"
    query = follow_references(_stream(spark, _events(spark, d), "events", 4), folder, availableNow=True)
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else -1
    if last < 0:
        return spark.createDataFrame([], "ref_field string, record_id bigint")
    waiting = read_state(spark, folder, last).refs.where("orphan")
    return waiting.select(F.col("field").alias("ref_field"), F.col("ref_id").alias("record_id")).distinct()


QUERIES = {f.__name__: f for f in (stream_event_windows, stream_references)}
ORACLES = {"stream_event_windows": EVALUATION["event_windows"], "stream_references": _FOUND}
