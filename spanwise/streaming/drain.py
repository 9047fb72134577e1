"""Working off what a stream source holds, once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..common import scratch_dir


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """All that the source holds now, through the stream's operators, as a table in the shared folder.

    In mode ``append`` every micro-batch adds its rows; in mode ``complete`` the last one has them all.
    A micro-batch writes to a place of its own, so that one that is run again replaces its rows.  A
    source without rows gives an empty table.
    """
    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    done: set[int] = set()

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/{number}")
        done.add(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    wanted = sorted(done) if mode == "append" else sorted(done)[-1:]
    if not wanted:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(f"{base}/{n}" for n in wanted))
