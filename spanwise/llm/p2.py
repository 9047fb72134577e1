"""Problem 2: one ranking per (run_id, case_id) from the four retrieval scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import table
from . import fusion

GROUP = ["run_id", "case_id"]
DIRECTIONS = {"dense_score": 1, "lexical_score": 1, "rrf_score": 1, "rerank_score": 1}


def p2_ranking(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(table(spark, d, "retrieved"), "run_id", GROUP, "rank", "chunk_id", DIRECTIONS, "logged_at")


def p2_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Judged rows by grade: how many, and their mean place in the fused ranking (0 top, 1 bottom) and in the run's own."""
    fused = p2_ranking(spark, d)
    sized = fused.withColumn("n", F.max("fused_rank").over(Window.partitionBy(*GROUP))).where("n > 1")
    judged = sized.join(table(spark, d, "judgments").select("case_id", "chunk_id", "grade"), ["case_id", "chunk_id"])
    place = lambda c: F.round(F.avg((F.col(c) - 1) / (F.col("n") - 1)), 6)
    return judged.groupBy("grade").agg(F.count("*").alias("n_items"), place("fused_rank").alias("mean_place_fused"), place("rank").alias("mean_place_own"))


QUERIES = {"p2_ranking": p2_ranking, "p2_agreement": p2_agreement}
ORACLES: dict[str, str] = {}
