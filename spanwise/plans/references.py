"""Problem 3: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import table
from ..operators import references as R

LABEL = r"^[\s\[\]]+|[\s\[\]]+$"


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Every reference and every arrival and deletion of a parent, with the time it came in."""
    c = F.col
    cites, spans, traces = table(spark, d, "citations"), table(spark, d, "evidence_spans"), table(spark, d, "traces")
    # one key of a run, a case and a label; lengths keep them apart, and a null run or case has none
    whole = lambda label: F.concat(F.length("run_id"), F.lit(":"), c("run_id"), F.length("case_id"), F.lit(":"), c("case_id"), label)
    label = F.upper(F.regexp_replace("label", LABEL, ""))
    asked = F.when(c("label").isNotNull(), F.coalesce(whole(label), F.concat(F.lit("?"), label)))
    shown = traces.select("run_id", "case_id", "ingested_at", F.explode(F.map_keys("context_labels")).alias("label"))
    return (
        R.reference_events(cites, "citations.chunk_id", c("citation_row_id"), c("chunk_id"), c("cited_at"), arrived=c("logged_at"))
        .unionByName(R.reference_events(spans, "evidence_spans.doc_id", c("span_row_id"), c("doc_id"), c("authored_at")))
        .unionByName(R.reference_events(cites, "citations.label", c("citation_row_id"), asked, F.lit(R.AT_LAST), c("cited_at"), c("logged_at")))
        .unionByName(R.parent_events(table(spark, d, "chunks"), "citations.chunk_id", c("chunk_id"), c("indexed_at"), c("deleted_at")))
        .unionByName(R.parent_events(table(spark, d, "corpus_docs"), "evidence_spans.doc_id", c("doc_id"), c("indexed_at"), c("retired_at")))
        .unionByName(R.parent_events(shown, "citations.label", whole(c("label")), F.lit(R.ALWAYS), F.lit(None), c("ingested_at")))
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The references that wait, after everything has come in, in the order of arrival."""
    refs = R.follow(_events(spark, d)).refs
    return refs.where("orphan").select(F.col("field").alias("ref_field"), F.col("ref_id").alias("record_id")).distinct()


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per table field and month: references, orphans when made, and references pending at the month's end."""
    state = R.follow(_events(spark, d))
    month = F.date_trunc("month", "made_at").cast("timestamp_ntz").alias("month")
    made = state.refs.groupBy(F.col("field").alias("ref_field"), month).agg(F.count("*").alias("n_references"), F.count(F.when(F.col("orphan"), 1)).alias("n_orphans"))
    timed = R.state_events(state).where("field <> 'citations.label'")
    pending = R.pending_by_period(timed).select(F.col("field").alias("ref_field"), F.col("period").alias("month"), "n_pending")
    # labels do not depend on time: what was an orphan stays one
    so_far = F.sum("n_orphans").over(Window.partitionBy("ref_field").orderBy(F.col("month").asc_nulls_last()))
    n_pending = F.when(F.col("ref_field") == "citations.label", so_far).otherwise(F.coalesce("n_pending", F.lit(0)))
    return made.join(pending, ["ref_field", "month"], "left").select("ref_field", "month", "n_references", "n_orphans", n_pending.alias("n_pending"))


QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts}

_FOUND = r"""
SELECT DISTINCT 'citations.chunk_id' AS ref_field, citation_row_id AS record_id FROM citations c
WHERE chunk_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunks p WHERE p.chunk_id = c.chunk_id AND p.indexed_at <= c.cited_at AND (p.deleted_at IS NULL OR c.cited_at < p.deleted_at))
UNION
SELECT DISTINCT 'citations.label', citation_row_id FROM citations c
WHERE label IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT run_id, case_id, unnest(map_keys(context_labels)) AS k FROM traces) p
  WHERE p.run_id = c.run_id AND p.case_id = c.case_id AND p.k = upper(regexp_replace(c.label, '^[\s\[\]]+|[\s\[\]]+$', '', 'g')))
UNION
SELECT DISTINCT 'evidence_spans.doc_id', span_row_id FROM evidence_spans c
WHERE doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM corpus_docs p WHERE p.doc_id = c.doc_id AND p.indexed_at <= c.authored_at AND (p.retired_at IS NULL OR c.authored_at < p.retired_at))
"""

ORACLES = {
    "p3_found": _FOUND,
    "p3_counts": f"""
WITH found AS ({_FOUND}),
refs AS (
  SELECT DISTINCT 'citations.chunk_id' AS ref_field, citation_row_id AS record_id, chunk_id AS k, cited_at AS t FROM citations WHERE chunk_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'citations.label', citation_row_id, label, cited_at FROM citations WHERE label IS NOT NULL
  UNION ALL SELECT DISTINCT 'evidence_spans.doc_id', span_row_id, doc_id, authored_at FROM evidence_spans WHERE doc_id IS NOT NULL),
marked AS (
  SELECT r.*, date_trunc('month', t)::TIMESTAMP AS month, f.record_id IS NOT NULL AS orphan FROM refs r LEFT JOIN found f USING (ref_field, record_id)),
made AS (SELECT ref_field, month, count(*) AS n_references, count(*) FILTER (orphan) AS n_orphans FROM marked GROUP BY ALL),
there AS (
  SELECT DISTINCT 'citations.chunk_id' AS ref_field, chunk_id AS k, indexed_at AS a, deleted_at AS z FROM chunks
  UNION ALL SELECT DISTINCT 'evidence_spans.doc_id', doc_id, indexed_at, retired_at FROM corpus_docs),
per_key AS (
  SELECT m.ref_field, m.month, r.k, count(*) AS n FROM made m JOIN marked r ON r.ref_field = m.ref_field AND r.t < m.month + INTERVAL 1 MONTH
  WHERE m.ref_field <> 'citations.label' GROUP BY ALL),
pending AS (
  SELECT ref_field, month, sum(n) AS n_pending FROM per_key p
  WHERE NOT EXISTS (SELECT 1 FROM there h WHERE h.ref_field = p.ref_field AND h.k = p.k AND h.a < p.month + INTERVAL 1 MONTH AND (h.z IS NULL OR h.z >= p.month + INTERVAL 1 MONTH))
  GROUP BY ALL),
labels AS (SELECT ref_field, month, sum(n_orphans) OVER (ORDER BY month) AS n_pending FROM made WHERE ref_field = 'citations.label')
SELECT m.ref_field, m.month, m.n_references, m.n_orphans, coalesce(p.n_pending, l.n_pending, 0)::BIGINT AS n_pending
FROM made m LEFT JOIN pending p USING (ref_field, month) LEFT JOIN labels l USING (ref_field, month)
""",
}
