"""The tables as the operators want them: one row per key, whatever was delivered twice or late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in *order*; null keys are keys like any other."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def traces(df: DataFrame) -> DataFrame:
    """One row per (run_id, case_id), the latest delivery; split without blanks and in lower case."""
    # a hash instead of the texts: what a query does not read is not shuffled for the sake of ties
    order = [F.col("ingested_at").desc_nulls_last(), F.xxhash64("answer", "query", "split")]
    return latest(df, ["run_id", "case_id"], order).withColumn("split", F.lower(F.trim("split")))


def retrieved(df: DataFrame) -> DataFrame:
    """One row per (run_id, case_id, rank), the latest delivery."""
    return latest(df, ["run_id", "case_id", "rank"], [F.col("logged_at").desc_nulls_last(), F.col("chunk_id").asc_nulls_last()])


def spans(df: DataFrame) -> DataFrame:
    """One row per span_row_id."""
    return latest(df, ["span_row_id"], [F.col("authored_at").desc_nulls_last(), F.xxhash64("quote")])


def citations(df: DataFrame) -> DataFrame:
    """One row per citation_row_id, the latest delivery."""
    return latest(df, ["citation_row_id"], [F.col("logged_at").desc_nulls_last(), F.col("label").asc_nulls_last()])


def documents(df: DataFrame) -> DataFrame:
    """One row per doc_id of corpus_docs."""
    return latest(df, ["doc_id"], [F.col("indexed_at").desc_nulls_last(), F.col("sha256").asc_nulls_last()])


def chunks(df: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, text, char_start, char_end, heading_path), one row per chunk_id."""
    order = [F.col("indexed_at").desc_nulls_last(), F.col("char_start").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("heading_path").isNull().asc()]
    return latest(df.select("chunk_id", "doc_id", "text", "char_start", "char_end", "heading_path", "indexed_at"), ["chunk_id"], order).drop("indexed_at")


#: The same in SQL, for the queries' oracles.
SQL = {
    "tr": "tr AS (SELECT * REPLACE (lower(trim(split)) AS split) FROM traces QUALIFY row_number() OVER (PARTITION BY run_id, case_id ORDER BY ingested_at DESC NULLS LAST, answer NULLS LAST, query NULLS LAST, split NULLS LAST) = 1)",
    "re": "re AS (SELECT * FROM retrieved QUALIFY row_number() OVER (PARTITION BY run_id, case_id, rank ORDER BY logged_at DESC NULLS LAST, chunk_id NULLS LAST) = 1)",
    "sp": "sp AS (SELECT * FROM evidence_spans QUALIFY row_number() OVER (PARTITION BY span_row_id ORDER BY authored_at DESC NULLS LAST, quote NULLS LAST) = 1)",
    "ci": "ci AS (SELECT * FROM citations QUALIFY row_number() OVER (PARTITION BY citation_row_id ORDER BY logged_at DESC NULLS LAST, label NULLS LAST) = 1)",
    "do": "d AS (SELECT * FROM corpus_docs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY indexed_at DESC NULLS LAST, sha256 NULLS LAST) = 1)",
    "ch": "ch AS (SELECT chunk_id, doc_id, text, char_start, char_end, heading_path FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST, char_start NULLS LAST, doc_id NULLS LAST, heading_path IS NULL) = 1)",
}


def with_(*names: str) -> str:
    """A WITH clause of cleaned tables."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
