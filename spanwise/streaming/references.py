"""The state of references, kept on a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..common import materialise
from ..operators import references as R

CHANGES = "field string, key string, t timestamp_ntz, delta bigint"
REFS = "field string, key string, t timestamp_ntz, made_at timestamp_ntz, ref_id bigint, orphan boolean"


def read_state(spark: SparkSession, folder: str, version: int) -> R.State:
    """The state after micro-batch *version*."""
    at = f"{folder}/state/{version}"
    refs = spark.read.schema(REFS).parquet(f"{at}/refs")
    return R.State(spark.read.schema(CHANGES).parquet(f"{at}/changes"), refs, spark.read.parquet(f"{at}/snapshot"))


def follow_references(events: DataFrame, folder: str, **trigger: object) -> StreamingQuery:
    """Takes in a stream of events (see ``operators.references``), batch by batch, in any order.

    *folder* is in the shared storage.  Micro-batch n reads state n - 1 and writes ``state/n`` (with its
    snapshot of counts) and ``changed/n`` (what became of references); one that is run again after a
    failure reads and writes the same, so nothing counts twice.
    """

    def put(batch: DataFrame, n: int) -> None:
        before = read_state(batch.sparkSession, folder, n - 1) if n else None
        state, changed = R.advance(before, materialise(batch))
        for name, df in (("changes", state.changes), ("refs", state.refs), ("snapshot", state.snapshot)):
            df.write.mode("overwrite").parquet(f"{folder}/state/{n}/{name}")
        changed.write.mode("overwrite").parquet(f"{folder}/changed/{n}")

    return events.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger).foreachBatch(put).start()
