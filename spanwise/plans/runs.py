"""A whole run: documents and cases to traces, metrics and a summary."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import platform
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..common import materialise
from ..config import Config
from ..errors import ConfigError
from ..functions import matchers
from ..functions import text as T
from ..operators import embedding as E
from ..operators import generation as N
from ..operators import metrics as A
from ..operators import retrieval as R
from ..operators import stats as G
from ..operators.chunking import build_chunker
from ..sources.traces import SCHEMA_VERSION, write_traces

KEY = ["run_id", "case_id"]


def build_chunks(docs: DataFrame, config: Config) -> DataFrame:
    return materialise(build_chunker(config.chunker.kind, **config.chunker.params)(docs))


def retrieve(cases: DataFrame, chunks: DataFrame, config: Config) -> DataFrame:
    """(case_id, rank, chunk_id, dense_score, lexical_score, rrf_score, score, doc_id, char_start, char_end, heading_path, text)."""
    r = config.retrieval
    if r.kind not in R.RETRIEVERS:
        raise ConfigError(f"unknown retrieval: {r.kind!r}")
    queries = cases.select(F.col("case_id").alias("query_id"), F.col("question").alias("text"))
    k = r.fetch_k if r.kind == "hybrid_rrf" else r.top_k
    members: dict[str, DataFrame] = {}
    if r.kind != "bm25":
        model = E.fit_embedder(config.embedder.kind, chunks.select("text"), **config.embedder.params)
        items = E.encode(chunks.select(F.col("chunk_id").alias("item_id"), "text"), model)
        members["dense"] = materialise(R.dense_top_k(E.encode(queries, model).select("query_id", "vector"), items.select("item_id", "vector"), k, model.dimension))
    if r.kind != "dense":
        members["lexical"] = materialise(R.bm25_top_k(queries, chunks.select(F.col("chunk_id").alias("item_id"), "text"), k))
    named = [m.select(F.col("query_id").alias("case_id"), F.col("item_id").alias("chunk_id"), "rank", "score", F.lit(n).alias("member")) for n, m in members.items()]
    every = named[0] if len(named) == 1 else named[0].unionByName(named[1])
    own = every.groupBy("case_id", "chunk_id").agg(*[F.max(F.when(F.col("member") == n, F.col("score"))).alias(f"{n}_score") for n in ("dense", "lexical")])
    if r.kind == "hybrid_rrf":
        top = R.rrf(every, r.top_k, ["case_id"], k_rrf=r.k_rrf).withColumn("rrf_score", F.col("score"))
    else:
        top = every.select("case_id", "chunk_id", "rank", "score").withColumn("rrf_score", F.lit(None).cast("double"))
    # equal texts of a document share an id: the first place stands for all
    place = chunks.groupBy("chunk_id").agg(F.min(F.struct("char_start", "char_end", "doc_id", "heading_path", "text")).alias("p")).select("chunk_id", "p.*")
    ranked = top.join(own, ["case_id", "chunk_id"]).join(place, "chunk_id")
    if r.deduplicate:
        kept = R.drop_repeats(ranked.select("case_id", "chunk_id", "rank", "text"), ["case_id"], r.dedupe_threshold)
        ranked = ranked.drop("rank").join(kept.select("case_id", "chunk_id", "rank"), ["case_id", "chunk_id"])
    return materialise(ranked)


def run(spark: SparkSession, config: Config, docs: DataFrame, tables: dict[str, DataFrame], responses: DataFrame, *, dataset_id: str = "", corpus_sha: str = "", run_id: str | None = None, limit: int | None = None) -> dict[str, DataFrame]:
    """Every case through the pipeline, set at a time.

    docs(doc_id, body), tables as ``load_cases`` gives them, responses as ``generation.RESPONSES``.  Returns
    chunks, retrieved, traces, claims, citations, metrics and summary.  A case without an answer is a trace
    with errors and without metrics; the others go on.
    """
    cases = tables["cases"] if limit is None else tables["cases"].orderBy("case_pos").limit(limit)
    split = "-".join(sorted(r[0] for r in cases.select("split").distinct().limit(3).collect()))
    started = dt.datetime.now(dt.UTC)
    run_id = run_id or f"{config.name}-{split}-{started:%Y%m%dT%H%M%SZ}-{config.config_hash[:8]}"
    template = config.generator.prompt_template
    sha = hashlib.sha256(template.encode()).hexdigest()[:16]

    chunks = build_chunks(docs, config)
    ranked = retrieve(cases, chunks, config).withColumn("run_id", F.lit(run_id))
    packed = N.pack_context(ranked, KEY)
    prompts = cases.withColumn("run_id", F.lit(run_id)).join(packed, KEY, "left").withColumn("prompt", N.render_prompt(template, F.col("context_text"), F.col("question")))
    answered = materialise(N.build_generator(config.generator.kind, responses)(prompts))
    ok = answered.where("size(errors) = 0")

    claims = ok.select(*KEY, F.explode(T.split_claims("answer")).alias("c")).select(*KEY, "c.*")
    labels = ok.select(*KEY, F.explode("context_labels").alias("label", "chunk_id"))
    citations = A.bind_citations(claims, labels, ranked, docs)
    spans = tables["spans"].withColumn("span_id", F.col("span_idx"))
    expected = cases.select("case_id", F.explode("expected_document_ids").alias("doc_id"))
    behaviour = A.abstention(ok).withColumnsRenamed({"expected": "abstention_expected", "observed": "abstention_observed", "correct": "abstention_correct"})
    parts = [
        A.retrieval_metrics(ok.select(*KEY), spans, ranked, config.evaluation.hit_coverage_threshold, tuple(config.evaluation.recall_at_k)),
        A.document_recall(ok.select(*KEY), expected, ranked),
        fact_coverage(ok, tables["facts"]),
        A.forbidden_claims(ok.select(*KEY, "answer"), cases.select("case_id", F.explode("forbidden_claims").alias("claim"))),
        behaviour,
        A.citation_metrics(ok.select(*KEY), claims, citations, expected),
    ]
    metrics = ok.select(*KEY, "category", "answerable")
    for part in parts:
        metrics = metrics.join(part, KEY, "left")
    metrics = materialise(metrics)

    shown = F.struct("rank", "chunk_id", "doc_id", "char_start", "char_end", "heading_path", "score", "dense_score", "lexical_score", "rrf_score", F.lit(None).cast("double").alias("rerank_score"))
    lists = ranked.groupBy(*KEY).agg(F.array_sort(F.collect_list(shown)).alias("retrieved"))
    claim_lists = claims.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("char_start", F.struct("claim_id", "text", "char_start", "char_end", "cited_labels").alias("c")))).alias("x")).select(*KEY, F.transform("x", lambda v: v["c"]).alias("claims"))
    order = F.struct("claim_id", "pos", F.struct("claim_id", "label", "chunk_id", "doc_id", "source_char_start", "source_char_end", "quoted_text", "resolved").alias("c"))
    cite_lists = citations.groupBy(*KEY).agg(F.array_sort(F.collect_list(order)).alias("x")).select(*KEY, F.transform("x", lambda v: v["c"]).alias("citations"), F.transform(F.filter("x", lambda v: ~v["c"]["resolved"]), lambda v: v["c"]["label"]).alias("unresolved_labels"))
    values = metrics.select(*KEY, F.struct(*[c for c in metrics.columns if c not in (*KEY, "category", "answerable")]).alias("metrics"))
    traces = answered.join(lists, KEY, "left").join(claim_lists, KEY, "left").join(cite_lists, KEY, "left").join(values, KEY, "left")
    now = dt.datetime.now(dt.UTC).isoformat()
    constants = {
        "pipeline_name": config.name, "config_hash": config.config_hash, "pipeline_hash": config.pipeline_hash, "template_sha": sha, "corpus_manifest_sha": corpus_sha, "dataset_id": dataset_id,
        "schema_version": SCHEMA_VERSION, "retrieval_kind": config.retrieval.kind, "top_k": config.retrieval.top_k, "started_at": started.isoformat(), "finished_at": now,
    }
    traces = traces.select(
        *KEY, *[F.lit(v).alias(k) for k, v in constants.items()], "split", F.col("question").alias("query"), "category", "answerable", "expected_behaviour", "retrieved", "context_labels", "context_text",
        F.substring(F.sha2("context_text", 256), 1, 16).alias("context_sha"), F.col("model").alias("generator_model"), "prompt", "answer", T.detect_abstention("answer").alias("abstained"), T.detect_clarification("answer").alias("clarification_requested"),
        "claims", "citations", "unresolved_labels", "metrics", "prompt_tokens", "completion_tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), "latency_ms", F.lit(True).alias("cache_hit"), "errors", F.lit(None).cast("double").alias("estimated_cost_usd"), environment(spark, config.seed).alias("environment"),
    )
    return {"chunks": chunks, "retrieved": ranked, "traces": traces, "claims": claims, "citations": citations, "metrics": metrics, "summary": summary(metrics, answered)}


def environment(spark: SparkSession, seed: int):
    """What a run depends on besides its inputs, as a map of texts."""
    values = {"python": platform.python_version(), "platform": platform.platform(), "spark": spark.version, "spanwise": __version__, "seed": str(seed)}
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def fact_coverage(answered: DataFrame, facts: DataFrame) -> DataFrame:
    """(run_id, case_id, required_fact_coverage).  The facts of a data set are few and declared: each distinct
    matcher is compiled to an expression, once, and applied to the answers of its cases."""
    trees = [r[0] for r in facts.select("matcher_json").distinct().collect()]
    pairs = answered.select(*KEY, "answer").join(facts.select("case_id", "matcher_json", "weight"), "case_id")
    met = F.lit(None).cast("boolean")
    for tree in trees:
        met = F.when(F.col("matcher_json") == tree, matchers.compile_matcher(json.loads(tree), F.col("answer"))).otherwise(met)
    per = pairs.select(*KEY, "weight", met.alias("met")).groupBy(*KEY).agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("met"), F.col("weight")).otherwise(0.0)).alias("hit"))
    return answered.select(*KEY).join(per, KEY, "left").select(*KEY, F.when(F.col("total") > 0, F.col("hit") / F.col("total")).alias("required_fact_coverage"))


def summary(metrics: DataFrame, answered: DataFrame) -> DataFrame:
    """(run_id, metric, n, mean): every numeric metric, and the numbers of cases and errors."""
    names = [c for c, t in metrics.dtypes if t in ("double", "int", "bigint", "boolean") and c not in (*KEY, "answerable")]
    means = G.summarise(metrics, ["run_id"], names)
    errors = answered.groupBy("run_id").agg(F.count("*").alias("n"), F.avg(F.when(F.size("errors") > 0, 1.0).otherwise(0.0)).alias("mean")).withColumn("metric", F.lit("error_rate"))
    return means.unionByName(errors)


def write_run(result: dict[str, DataFrame], config: Config, out: str | Path) -> Path:
    """The run's folder: its resolved configuration, its trace and its metrics."""
    run_id = result["traces"].select("run_id").head()[0]
    folder = Path(out) / run_id
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "config.resolved.json").write_text(json.dumps(asdict(config), indent=2, sort_keys=True), "utf-8")
    write_traces(result["traces"], str(folder / "trace.jsonl"))
    rows = [r.asDict() for r in result["summary"].orderBy("metric").collect()]  # one row per metric
    (folder / "metrics.json").write_text(json.dumps({r["metric"]: {"n": r["n"], "mean": r["mean"]} for r in rows}, indent=2, sort_keys=True), "utf-8")
    return folder
