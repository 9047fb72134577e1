"""Stored results by content: a Parquet table, looked up by joins."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import short_hash
from ..errors import CacheMissError

VERSION = 1


def completion_key(*, provider: str, model: str, params: dict[str, Any], prompt: str, template_sha: str) -> str:
    """Of all that changes a completion and nothing else: no case, run or time."""
    return short_hash({"v": VERSION, "ns": "llm", "provider": provider, "model": model, "params": params, "template_sha": template_sha, "prompt": prompt}, 64)


class Cache:
    """A table (key, payload, version) below *root*, in folders by the first two digits of the key."""

    def __init__(self, spark: SparkSession, root: str | Path, namespace: str) -> None:
        self.spark, self.path, self.namespace = spark, f"{root}/{namespace}", namespace

    def table(self) -> DataFrame:
        """What is stored, the newest entry of a key; entries of another version raise CacheMissError."""
        schema = "key string, payload string, version int, written_at timestamp, shard string"
        try:
            stored = self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], "key string, payload string")
        if not stored.where(F.col("version") != VERSION).isEmpty():
            raise CacheMissError(f"{self.namespace}: entries of another version; record them anew")
        return stored.groupBy("key").agg(F.max_by("payload", F.struct("written_at", "payload")).alias("payload"))

    def lookup(self, requests: DataFrame) -> DataFrame:
        """*requests*(key, ...) with payload and cache_hit."""
        return requests.join(self.table(), "key", "left").withColumn("cache_hit", F.col("payload").isNotNull())

    def misses(self, requests: DataFrame) -> DataFrame:
        return requests.join(self.table().select("key"), "key", "left_anti")

    def require(self, requests: DataFrame) -> DataFrame:
        """As ``lookup``; requests that are not stored raise CacheMissError."""
        lost = self.misses(requests).select("key").take(5)
        if lost:
            raise CacheMissError(f"{self.namespace}: not stored: {[r['key'][:12] for r in lost]}")
        return self.lookup(requests)

    def put(self, entries: DataFrame) -> None:
        """Append entries(key, payload); a commit is whole or not at all."""
        out = entries.select("key", "payload", F.lit(VERSION).alias("version"), F.current_timestamp().alias("written_at"), F.substring("key", 1, 2).alias("shard"))
        out.write.mode("append").partitionBy("shard").parquet(self.path)

    def stats(self) -> dict[str, int]:
        row = self.table().agg(F.count("*"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))).head()
        return {"entries": row[0], "bytes": row[1]}
