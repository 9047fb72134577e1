"""Problem 4: splitting oversized sections at natural boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from . import splitting


def _limit(spark: SparkSession, d: str, name: str) -> tuple[int, int]:
    """(max_size, overlap) of a named limit; the table has a fixed three rows."""
    row = table(spark, d, "size_limits").where(F.col("limit_name") == name).select("max_size", "overlap").head()
    return (row[0], row[1]) if row else {"section_piece": (1200, 120), "fixed_piece": (500, 50), "context_window": (2048, 0)}[name]


def _pieces(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    limit, overlap = _limit(spark, d, "section_piece")
    return splitting.split(table(spark, d, "corpus_docs"), "doc_id", "body", limit, overlap), overlap


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The sections that the splitter cuts: those with a second piece."""
    return _pieces(spark, d)[0].where("piece = 1").select("doc_id", F.col("section_start").alias("char_start")).distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)[0]


def p4_cover(spark: SparkSession, d: str) -> DataFrame:
    """Per document: sections, those cut, the longest piece, and the code points of all pieces without the overlaps: those of the body."""
    pieces, overlap = _pieces(spark, d)
    size = F.col("char_end") - F.col("char_start")
    first = F.count(F.when(F.col("piece") == 0, 1)).alias("n_sections")
    cut = F.count(F.when(F.col("piece") == 1, 1)).alias("n_cut")
    each = pieces.groupBy("doc_id").agg(first, cut, F.max(size).alias("longest"), F.sum(size - F.when(F.col("piece") > 0, overlap).otherwise(0)).alias("n_chars"))
    return each.select("doc_id", "n_sections", "n_cut", (F.col("longest") <= _limit(spark, d, "section_piece")[0]).alias("within"), "n_chars")


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces, "p4_cover": p4_cover}

_SECTIONS = r"""
WITH d AS (SELECT DISTINCT doc_id, body FROM corpus_docs WHERE length(body) > 0),
l AS (SELECT doc_id, body, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT *, string_split(body, chr(10)) AS ls FROM d)),
m AS (SELECT *, sum(length(line) + 1) OVER w - length(line) - 1 AS s, sum(starts_with(line, '```')::INT) OVER w AS fences FROM l
  WINDOW w AS (PARTITION BY doc_id, body ORDER BY i)),
h AS (SELECT doc_id, body, s FROM m WHERE fences % 2 = 0 AND regexp_matches(line, '^#{1,6}[ \t]') UNION SELECT doc_id, body, 0 FROM d),
sections AS (SELECT *, lead(s, 1, length(body)) OVER (PARTITION BY doc_id, body ORDER BY s) AS e FROM h)"""

ORACLES = {
    "p4_found": f"{_SECTIONS}\nSELECT DISTINCT doc_id, s::INTEGER AS char_start FROM sections WHERE e - s > 1200",
    "p4_cover": f"{_SECTIONS}\nSELECT doc_id, count(*) AS n_sections, count(*) FILTER (e - s > 1200) AS n_cut, true AS within, sum(e - s)::BIGINT AS n_chars FROM sections GROUP BY doc_id",
}
