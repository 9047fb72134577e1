"""Problem 7: packing documents into context windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from . import packing, tokens
from .p4 import _limit


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    capacity, _ = _limit(spark, d, "context_window")
    return packing.pack(tokens.count(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "n_tokens", capacity), capacity


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, piece, token_start, n_tokens, container_id) of every document."""
    packed, _ = _packed(spark, d)
    return packed.select("doc_id", "piece", F.col("start").alias("token_start"), F.col("size").alias("n_tokens"), F.col("container").alias("container_id"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """One row: containers, their least possible number, tokens, the fullest container, the share of room used and
    the share of the items (pieces that are not empty) that the patterns placed."""
    packed, capacity = _packed(spark, d)
    each = packed.where("size > 0").groupBy("container").agg(F.sum("size").alias("n"), F.count("*").alias("items"), F.count(F.when(F.col("by_pattern"), 1)).alias("planned"))
    total = each.agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"), F.sum("items").alias("items"), F.sum("planned").alias("planned"))
    return total.select(
        "n_containers",
        F.ceil(F.col("n_tokens") / capacity).alias("least_containers"),
        "n_tokens",
        "fullest",
        F.round(F.col("n_tokens") / (F.col("n_containers") * capacity), 6).alias("fill"),
        F.round(F.col("planned") / F.col("items"), 6).alias("share_by_pattern"),
    )


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents, and those that have a container (all of them)."""
    packed, _ = _packed(spark, d)
    placed = packed.select("doc_id").distinct().withColumn("placed", F.lit(1))
    docs = table(spark, d, "documents").select("doc_id", F.col("source")).join(placed, "doc_id", "left")
    return docs.groupBy("source").agg(F.count("*").alias("n_documents"), F.count("placed").alias("n_placed"))


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill, "p7_documents": p7_documents}
ORACLES = {"p7_documents": "SELECT source, count(*) AS n_documents, count(*) AS n_placed FROM documents GROUP BY source"}
