"""Problem 5: chunks with nearly the same text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from . import nearcopies
from .words import words_sql


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return nearcopies.near_pairs(table(spark, d, "chunks"), "chunk_id", "text", k=3, threshold=0.7, min_words=15)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.expand(*_near(spark, d)).select(F.col("key_a").alias("chunk_id_a"), F.col("key_b").alias("chunk_id_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.groups(*_near(spark, d)).withColumnRenamed("key", "chunk_id")


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different texts, each by its smallest chunk_id: the share of common k-mers, and the edit similarity by banded
    alignment, which is lower where blocks stand in another order."""
    members, links = _near(spark, d)
    name = lambda s: members.groupBy(F.col("cls").alias(f"cls_{s}")).agg(F.min("key").alias(f"chunk_{s}"))
    both = links.join(name("a"), "cls_a").join(name("b"), "cls_b")
    return both.select(F.least("chunk_a", "chunk_b").alias("chunk_id_a"), F.greatest("chunk_a", "chunk_b").alias("chunk_id_b"), F.round("jaccard", 6).alias("jaccard"), F.round("edit_similarity", 6).alias("edit_similarity"))


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups, "p5_links": p5_links}

_ALIKE = f"""
texts AS (SELECT DISTINCT chunk_id, {words_sql("text")} AS ws FROM chunks WHERE text IS NOT NULL),
once AS (SELECT ws, row_number() OVER (ORDER BY ws) AS id FROM (SELECT DISTINCT ws FROM texts WHERE len(ws) >= 15)),
grams AS (SELECT id, list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS gs FROM once),
each AS (SELECT id, unnest(gs) AS g, len(gs) AS n FROM grams),
alike AS (SELECT a.id AS ia, b.id AS ib, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM each a JOIN each b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),
named AS (SELECT chunk_id, id FROM texts JOIN once USING (ws))"""

ORACLES = {
    "p5_found": f"""WITH {_ALIKE},
pairs AS (SELECT a.chunk_id AS a, b.chunk_id AS b FROM alike JOIN named a ON a.id = ia JOIN named b ON b.id = ib WHERE j >= 0.7 - 1e-9
  UNION SELECT a.chunk_id, b.chunk_id FROM named a JOIN named b USING (id))
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM pairs WHERE a <> b""",
    "p5_groups": f"""WITH RECURSIVE {_ALIKE},
both_ways AS (SELECT ia, ib FROM alike WHERE j >= 0.7 - 1e-9 UNION SELECT ib, ia FROM alike WHERE j >= 0.7 - 1e-9),
reach AS (SELECT id, id AS r FROM once UNION SELECT reach.id, ib FROM reach JOIN both_ways ON ia = r),
roots AS (SELECT reach.id, min(chunk_id) AS group_id FROM reach JOIN named ON named.id = r GROUP BY reach.id),
linked AS (SELECT ia AS id, count(*) AS n FROM both_ways GROUP BY ia)
SELECT chunk_id, min(group_id) AS group_id, sum(coalesce(n, 0))::BIGINT AS n_links FROM named JOIN roots USING (id) LEFT JOIN linked USING (id) GROUP BY chunk_id""",
}
