"""Problem 8: texts that stop before their author's end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import materialise, table
from . import truncation


def _judge(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return truncation.judge(table(spark, d, "documents"), "doc_id", "text", "source")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _judge(spark, d)[0].where("cut").select(F.col("key").alias("doc_id")).distinct()


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per source: texts that are not blank, those cut off and their share, and the limits that were found, if any."""
    judged, limits = _judge(spark, d)
    limit = limits.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "max_size", "unit"))), ", ").alias("limits"))
    rates = judged.groupBy("source").agg(F.count("*").alias("n_texts"), F.count(F.when(F.col("cut"), 1)).alias("n_cut"))
    return rates.join(limit, "source", "left").select("source", "n_texts", "n_cut", F.round(F.col("n_cut") / F.col("n_texts"), 6).alias("share_cut"), "limits")


def p8_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of ending: texts, those at a limit, those found by both, by the length alone and by the ending alone
    (with the odds of a text of unknown length), and the mean learned weight of the ending."""
    judged = materialise(_judge(spark, d)[0])
    prior = judged.agg(F.min("by_length")).head()[0]
    finished = F.col("kind").isin(*truncation.FINISHED)
    n = lambda c: F.count(F.when(c, 1))
    return judged.groupBy("kind").agg(
        F.count("*").alias("n_texts"),
        n(F.col("p_length") >= 0.5).alias("n_at_limit"),
        n(F.col("cut")).alias("n_cut"),
        n(F.col("by_length") > 0).alias("n_by_length"),
        n((F.col("by_ending") + F.lit(prior) > 0) & ~finished).alias("n_by_ending"),
        F.round(F.avg("by_ending"), 3).alias("weight"),
    )


QUERIES = {"p8_found": p8_found, "p8_rates": p8_rates, "p8_evidence": p8_evidence}
ORACLES: dict[str, str] = {}
