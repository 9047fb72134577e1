"""Trace records: their schema, reading and writing as JSON lines."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
RETRIEVED = "array<struct<rank:int,chunk_id:string,doc_id:string,char_start:int,char_end:int,heading_path:array<string>,score:double,dense_score:double,lexical_score:double,rrf_score:double,rerank_score:double>>"
CLAIMS = "array<struct<claim_id:string,text:string,char_start:int,char_end:int,cited_labels:array<string>>>"
CITATIONS = "array<struct<citation_id:string,claim_id:string,label:string,chunk_id:string,doc_id:string,source_char_start:int,source_char_end:int,quoted_text:string,resolved:boolean,authoritative:boolean,support:string,support_score:double>>"
METRICS = (
    "struct<recall_at_1:double,recall_at_3:double,recall_at_5:double,recall_at_10:double,precision_at_1:double,precision_at_3:double,precision_at_5:double,precision_at_10:double,mrr:double,document_recall:double,"
    "required_fact_coverage:double,forbidden_claims:int,abstention_expected:string,abstention_observed:string,abstention_correct:boolean,n_citations:int,n_resolved:int,n_fabricated:int,citation_validity:double,"
    "citation_precision_doc:double,claim_citation_coverage:double,distinct_docs_cited:int,n_claims:int>"
)
TRACE = (
    "run_id string, case_id string, pipeline_name string, config_hash string, pipeline_hash string, template_sha string, corpus_manifest_sha string, dataset_id string, split string, schema_version int, query string, category string, "
    f"answerable boolean, expected_behaviour string, retrieval_kind string, top_k int, retrieved {RETRIEVED}, rewritten_queries array<string>, context_labels map<string,string>, context_text string, context_sha string, generator_model string, "
    f"prompt string, answer string, abstained boolean, clarification_requested boolean, claims {CLAIMS}, citations {CITATIONS}, unresolved_labels array<string>, metrics {METRICS}, evaluator_outputs array<map<string,string>>, "
    "failure_classes array<string>, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, latency_ms double, cache_hit boolean, estimated_cost_usd double, errors array<string>, started_at string, finished_at string, environment map<string,string>"
)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace records under the declared schema: no inference, blank lines passed over, a directory of a run by its trace.jsonl."""
    if Path(path).is_dir() and (Path(path) / "trace.jsonl").exists():
        path = str(Path(path) / "trace.jsonl")
    return spark.read.schema(TRACE).json(path).where("run_id IS NOT NULL OR case_id IS NOT NULL")


def write_traces(traces: DataFrame, path: str) -> None:
    """JSON lines with keys in order, in place of what was there."""
    traces.select(*sorted(traces.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def retrieved_of(traces: DataFrame) -> DataFrame:
    """The retrieval lists as rows (run_id, case_id, rank, ...)."""
    return traces.select("run_id", "case_id", F.explode("retrieved").alias("r")).select("run_id", "case_id", "r.*")
