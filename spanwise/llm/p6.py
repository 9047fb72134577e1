"""Problem 6: encoding of the whole corpus with byte_bpe_50k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from . import tokens


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Per source: texts, tokens, and texts whose ids decode to other bytes than the text's own (none)."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    back = tokens.decode(p6_ids(spark, d), "doc_id", "ids")
    sizes = tokens.count(docs, "doc_id", "text")
    both = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")).join(back.select("doc_id", F.col("text").alias("decoded")), "doc_id").join(sizes, "doc_id")
    return both.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"), F.count(F.when(~F.col("text").eqNullSafe(F.col("decoded")), 1)).alias("n_unlike"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Per source: texts, and the characters and bytes that their ids decode to: those of the texts."""
    back = tokens.decode(p6_ids(spark, d), "doc_id", "ids")
    both = table(spark, d, "documents").select("doc_id", "source").join(back, "doc_id")
    return both.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.octet_length("raw")).alias("n_bytes"))


QUERIES = {"p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p6_decoded": p6_decoded}
ORACLES = {"p6_decoded": "SELECT source, count(*) AS n_texts, sum(coalesce(length(text), 0))::BIGINT AS n_chars, sum(coalesce(strlen(text), 0))::BIGINT AS n_bytes FROM documents GROUP BY source"}
