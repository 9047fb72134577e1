"""Queries that write what the tables hold in the library's own formats and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import scratch_dir, table
from ..operators import model as M
from ..operators import validate as V
from ..sources import traces as TR
from ..sources.cache import Cache
from ..sources.corpus import read_checksums


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def trace_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Trace records with their retrieval lists, through JSON lines: per run the cases, tokens, labels, errors and retrieved chunks."""
    rows = M.retrieved(table(spark, d, "retrieved")).groupBy("run_id", "case_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "doc_id", "char_start", "char_end"))).alias("retrieved"))
    traces = M.traces(table(spark, d, "traces")).join(rows, ["run_id", "case_id"], "left").drop("ingested_at")
    path = _folder(spark, "traces")
    TR.write_traces(traces, path)
    back = TR.read_traces(spark, path)
    chunks = TR.retrieved_of(back).groupBy("run_id").agg(F.count("*").alias("n_retrieved"), F.sum("rank").cast("bigint").alias("sum_rank"))
    per_run = back.groupBy("run_id").agg(
        F.count("*").alias("n_cases"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum(F.when(F.col("context_labels").isNotNull(), F.size("context_labels")).otherwise(0)).alias("n_labels"),
        F.sum(F.when(F.size("errors") > 0, 1).otherwise(0)).alias("n_errors"),
        F.sum(F.length("answer")).alias("answer_chars"),
    )
    return per_run.join(chunks, "run_id", "left")


def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The answers of one pipeline, stored by configuration and query; then the requests of every pipeline: found, and not."""
    t = M.traces(table(spark, d, "traces")).where("query IS NOT NULL AND answer IS NOT NULL").select("pipeline_name", F.sha2(F.concat_ws("|", "config_hash", "query"), 256).alias("key"), F.col("answer").alias("payload"))
    cache = Cache(spark, _folder(spark, "cache"), "answers")
    cache.put(t.where("pipeline_name = 'baseline'").select("key", "payload"))
    found = cache.lookup(t.select("pipeline_name", "key"))
    return found.groupBy("pipeline_name").agg(F.count("*").alias("n"), F.count(F.when(F.col("cache_hit"), 1)).alias("n_hits"), F.countDistinct(F.when(~F.col("cache_hit"), F.col("key"))).alias("n_missing_keys"))


def checksum_list(spark: SparkSession, d: str) -> DataFrame:
    """The recorded checksums as a list of lines, read back and held against the bodies with plain line ends: what differs or is lost."""
    docs = M.documents(table(spark, d, "corpus_docs"))
    path = _folder(spark, "checksums")
    docs.select(F.concat("sha256", F.lit("  "), "doc_id").alias("value")).where("value IS NOT NULL").write.text(path)
    actual = docs.where("body <> ''").select(F.col("doc_id").alias("path"), F.sha2(F.replace("body", F.lit("\r\n"), F.lit("\n")), 256).alias("actual"))
    return V.checksums(read_checksums(spark, path), actual)


QUERIES = {f.__name__: f for f in (trace_round_trip, cache_lookup, checksum_list)}

ORACLES = {
    "trace_round_trip": f"""{M.with_("tr", "re")},
c AS (SELECT run_id, count(*) AS n_retrieved, sum(rank)::BIGINT AS sum_rank FROM re JOIN (SELECT run_id, case_id FROM tr) USING (run_id, case_id) GROUP BY run_id),
t AS (SELECT run_id, count(*) AS n_cases, sum(total_tokens)::BIGINT AS total_tokens, sum(coalesce(cardinality(context_labels), 0))::BIGINT AS n_labels, sum((coalesce(len(errors), 0) > 0)::INT)::BIGINT AS n_errors, sum(length(answer))::BIGINT AS answer_chars
  FROM tr WHERE run_id IS NOT NULL OR case_id IS NOT NULL GROUP BY run_id)
SELECT t.*, n_retrieved, sum_rank FROM t LEFT JOIN c USING (run_id)""",
    "cache_lookup": f"""{M.with_("tr")}, k AS (SELECT pipeline_name, concat_ws('|', config_hash, query) AS key FROM tr WHERE query IS NOT NULL AND answer IS NOT NULL),
h AS (SELECT *, key IN (SELECT key FROM k WHERE pipeline_name = 'baseline') AS hit FROM k)
SELECT pipeline_name, count(*) AS n, count(*) FILTER (hit) AS n_hits, count(DISTINCT key) FILTER (NOT hit) AS n_missing_keys FROM h GROUP BY pipeline_name""",
    "checksum_list": f"""{M.with_("do")}
SELECT * FROM (SELECT doc_id AS path, CASE WHEN body IS NULL OR body = '' THEN 'MISSING' WHEN sha256(replace(body, chr(13) || chr(10), chr(10))) <> sha256 THEN 'CHANGED' END AS problem FROM d WHERE regexp_matches(sha256, '^[0-9a-f]{{64}}$') AND regexp_matches(doc_id, '^\\S+$'))
WHERE problem IS NOT NULL""",
}
