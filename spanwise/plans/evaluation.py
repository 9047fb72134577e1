"""Queries on runs: retrieval, citations, answers, summaries, comparisons, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import materialise, table
from ..functions import text as T
from ..functions.matchers import compile_matcher
from ..functions.matchers import fact_coverage as matched_share
from ..operators import metrics as A
from ..operators import model as M
from ..operators import retrieval as R
from ..operators import stats as G
from ..operators import taxonomy as X
from ..operators import validate as V


KEY = ["run_id", "case_id"]


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _traces(spark: SparkSession, d: str) -> DataFrame:
    return M.traces(table(spark, d, "traces"))


def _retrieved(spark: SparkSession, d: str) -> DataFrame:
    return M.retrieved(table(spark, d, "retrieved"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return M.spans(table(spark, d, "evidence_spans")).withColumnRenamed("span_row_id", "span_id")


def _ok(df: DataFrame) -> DataFrame:
    """Without failed runs."""
    return df.where("coalesce(size(errors), 0) <= 0")


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return _ok(_traces(spark, d)).select(*KEY)


def _expected(spark: SparkSession, d: str) -> DataFrame:
    """(case_id, doc_id): the documents a case's evidence is in."""
    return _spans(spark, d).where("doc_id IS NOT NULL AND case_id IS NOT NULL").select("case_id", "doc_id").distinct()


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """(case_id, value, weight): the first number of each evidence quote."""
    return _spans(spark, d).select("case_id", F.get(T.numbers_in("quote"), F.lit(0)).alias("value"), F.when(F.col("authoritative"), 1.0).otherwise(0.5).alias("weight")).where("value IS NOT NULL AND case_id IS NOT NULL")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, text): the query of every case whose number is divisible by 100: the stated query set."""
    q = table(spark, d, "traces").where("query IS NOT NULL AND cast(regexp_extract(case_id, '([0-9]+)$', 1) AS bigint) % 100 = 0")
    return q.groupBy(F.col("case_id").alias("query_id")).agg(F.min("query").alias("text"))


def _chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    return M.chunks(table(spark, d, "chunks")).select(F.col("chunk_id").alias("item_id"), "text")


# --- ranking ---


def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = _chunk_texts(spark, d)
    n = docs.count()
    df = R.postings(docs).groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", "df", r6(R.idf(float(n), F.col("df"))).alias("idf"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.bm25_top_k(_queries(spark, d), _chunk_texts(spark, d), 10))


def _nearest(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return R.dense_top_k(queries, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), k, 64)


def dense_topk_exact(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_nearest(spark, d, 10))


def dense_label_precision(spark: SparkSession, d: str) -> DataFrame:
    """Share of the ten nearest other vectors that have the query's label, by label."""
    e = table(spark, d, "embeddings")
    label = e.select("vec_id", "label")
    own = Window.partitionBy("query_id").orderBy("rank")
    top = _nearest(spark, d, 11).where("query_id <> item_id").withColumn("n", F.row_number().over(own)).where("n <= 10")
    both = top.join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want")), "query_id").join(label.select(F.col("vec_id").alias("item_id"), "label"), "item_id")
    return both.groupBy(F.col("want").alias("label")).agg(F.count("*").alias("n"), r6(F.avg((F.col("want") == F.col("label")).cast("int"))).alias("precision"))


def embedding_norms(spark: SparkSession, d: str) -> DataFrame:
    norm = F.sqrt(F.aggregate(R.l2_normalise(F.col("embedding")), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(norm), 4).alias("mean_norm"))


def _member_ranks(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, case_id, chunk_id, rank) of the dense and the lexical order of hybrid retrievals."""
    ok = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), r6(c))
    hybrid = _traces(spark, d).where("retrieval_kind = 'hybrid_rrf'").select(*KEY)
    rows = _retrieved(spark, d).where("chunk_id IS NOT NULL").join(hybrid, KEY).select(*KEY, "chunk_id", ok("dense_score").alias("dense"), ok("lexical_score").alias("lexical"))
    member = lambda c: R.top_k(rows.where(f"{c} IS NOT NULL"), 30, KEY, score=c).select(*KEY, "chunk_id", "rank")
    return member("dense").unionByName(member("lexical"))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return R.rrf(_member_ranks(spark, d), 10, KEY).select(*KEY, "chunk_id", F.round("score", 9).alias("score"), "rank")


def dedup_greedy(spark: SparkSession, d: str) -> DataFrame:
    ranked = _retrieved(spark, d).join(M.chunks(table(spark, d, "chunks")).select("chunk_id", "text"), "chunk_id").select(*KEY, "chunk_id", "rank", "text")
    return R.drop_repeats(ranked, KEY)


def context_pack(spark: SparkSession, d: str) -> DataFrame:
    """The labelled context of every retrieval: its length, its number of excerpts and its hash."""
    ch = M.chunks(table(spark, d, "chunks")).select("chunk_id", "text", "heading_path")
    head = F.when(F.size("heading_path") > 0, F.array_join("heading_path", " > ")).otherwise(F.col("doc_id"))
    rows = _retrieved(spark, d).join(ch, "chunk_id").select(*KEY, F.struct("rank", "chunk_id", "doc_id", head.alias("head"), F.regexp_replace("text", r"^(?U)\s+|(?U)\s+$", "").alias("text")).alias("x"))
    lists = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    part = F.transform("xs", lambda x, i: F.concat(F.lit("[C"), (i + 1).cast("string"), F.lit("] ("), x["doc_id"], F.lit(" :: "), x["head"], F.lit(")\n"), x["text"]))
    text = F.array_join(part, "\n\n")
    return lists.select(*KEY, F.size("xs").alias("n_excerpts"), F.length(text).alias("n_chars"), F.substring(F.sha2(text, 256), 1, 16).alias("context_sha"))


# --- spans and retrieval metrics ---


def span_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.relevance(_spans(spark, d), _retrieved(spark, d)))


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.retrieval_metrics(_cases(spark, d), _spans(spark, d), _retrieved(spark, d)))


def ndcg_at_10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.ndcg(_cases(spark, d), _spans(spark, d), _retrieved(spark, d)))


def document_recall(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.document_recall(_cases(spark, d), _expected(spark, d), _retrieved(spark, d)))


def retrieval_scorecard(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over all chunks for the stated queries, scored against the evidence spans: one row per query."""
    found = R.bm25_top_k(_queries(spark, d), _chunk_texts(spark, d), 10)
    place = M.chunks(table(spark, d, "chunks")).select(F.col("chunk_id").alias("item_id"), "doc_id", "char_start", "char_end")
    ranked = materialise(found.join(place, "item_id").select(F.lit("bm25").alias("run_id"), F.col("query_id").alias("case_id"), "rank", "doc_id", "char_start", "char_end"))
    cases = _queries(spark, d).select(F.lit("bm25").alias("run_id"), F.col("query_id").alias("case_id"))
    return rounded(A.retrieval_metrics(cases, _spans(spark, d), ranked))


def budget_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Means at each pipeline's own budget (its smallest top_k) and at the common one."""
    runs = _ok(_traces(spark, d)).where("pipeline_name IS NOT NULL AND top_k IS NOT NULL")
    own = materialise(G.budgets(runs, "pipeline_name"))
    common = own.agg(F.min("budget")).head()[0]  # one number
    both = runs.select(*KEY, "pipeline_name").join(own, "pipeline_name").withColumn("common", F.lit(common).cast("int"))
    each = materialise(both.select(*KEY, "pipeline_name", F.explode(F.array(F.struct(F.lit("configured").alias("analysis"), F.col("budget").alias("k")), F.struct(F.lit("common").alias("analysis"), F.col("common").alias("k")))).alias("x")).select(F.concat_ws("|", "x.analysis", "run_id").alias("run_id"), "case_id", "pipeline_name", "x.analysis", "x.k"))
    got = _retrieved(spark, d).withColumn("a", F.explode(F.array(F.lit("configured"), F.lit("common")))).select(F.concat_ws("|", "a", "run_id").alias("run_id"), "case_id", "rank", "doc_id", "char_start", "char_end")
    cut = materialise(got.join(each.select(*KEY, "k"), KEY).where("rank <= k").drop("k"))
    scored = rounded(A.retrieval_metrics(each.select(*KEY), _spans(spark, d), cut, ks=(1000,)))
    docs = A.document_recall(each.select(*KEY), _expected(spark, d), cut)
    wide = each.join(scored, KEY).join(docs, KEY).withColumnsRenamed({"recall_at_1000": "recall", "precision_at_1000": "precision"})
    return wide.groupBy("analysis", "pipeline_name", "k").agg(F.count("recall").alias("n"), *[r6(F.avg(m)).alias(m) for m in ("recall", "mrr", "precision", "document_recall")])


# --- answers ---


def abstention_detect(spark: SparkSession, d: str) -> DataFrame:
    return _traces(spark, d).where("answer IS NOT NULL").select(*KEY, T.detect_abstention("answer").alias("abstained"), T.detect_clarification("answer").alias("clarified"))


def abstention_confusion(spark: SparkSession, d: str) -> DataFrame:
    return G.confusion(A.abstention(_ok(_traces(spark, d))), [])


def detector_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The recorded flag against the detector."""
    return _traces(spark, d).where("answer IS NOT NULL").select("abstained", T.detect_abstention("answer").alias("detected")).groupBy("abstained", "detected").agg(F.count("*").alias("n"))


def strip_labels(spark: SparkSession, d: str) -> DataFrame:
    return _traces(spark, d).where("answer IS NOT NULL").select(*KEY, T.strip_labels("answer").alias("plain"))


def extract_labels(spark: SparkSession, d: str) -> DataFrame:
    return _traces(spark, d).where("answer IS NOT NULL").select(*KEY, F.array_join(T.extract_labels("answer"), " ").alias("labels"))


def split_claims(spark: SparkSession, d: str) -> DataFrame:
    return A.claims(_traces(spark, d)).withColumn("cited_labels", F.array_join("cited_labels", " "))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return _traces(spark, d).select(*KEY, F.explode("context_labels").alias("label", "chunk_id"))


def bind_citations(spark: SparkSession, d: str) -> DataFrame:
    docs = M.documents(table(spark, d, "corpus_docs"))
    return A.bind_citations(A.claims(_traces(spark, d)), _labels(spark, d), _retrieved(spark, d), docs)


def _bound_labels(traces: DataFrame, retrieved: DataFrame) -> DataFrame:
    answers = traces.where("answer IS NOT NULL").select(*KEY, F.lit("cl0").alias("claim_id"), T.extract_labels("answer").alias("cited_labels"))
    labels = traces.select(*KEY, F.explode("context_labels").alias("label", "chunk_id"))
    bound = A.bind_citations(answers, labels, retrieved)
    return bound.groupBy(*KEY).agg(F.count("*").alias("n_citations"), F.count(F.when(F.col("resolved"), 1)).alias("n_resolved"), F.countDistinct(F.when(F.col("resolved"), F.col("doc_id"))).alias("n_documents"))


def bind_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of whole answers: how many lead to a retrieved chunk, and how many nowhere."""
    return _bound_labels(_traces(spark, d), _retrieved(spark, d))


def citation_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = _ok(_traces(spark, d))
    claims = A.claims(t)
    return rounded(A.citation_metrics(t.select(*KEY), claims, A.bind_citations(claims, _labels(spark, d), _retrieved(spark, d)), _expected(spark, d)))


def recorded_citations(spark: SparkSession, d: str) -> DataFrame:
    """Per run: citations as recorded, those marked resolved, mean support where there is one."""
    c = M.citations(table(spark, d, "citations"))
    return c.groupBy("run_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("resolved"), 1)).alias("n_resolved"), F.count("support_score").alias("n_supported"), r6(F.avg("support_score")).alias("mean_support"), F.countDistinct("doc_id").alias("n_documents"))


def citation_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Citations whose quoted text is not what stands at their place (the first 400 characters)."""
    c = M.citations(table(spark, d, "citations")).where("quoted_text IS NOT NULL AND source_char_start >= 0")
    docs = M.documents(table(spark, d, "corpus_docs")).select("doc_id", "body")
    there = F.expr("left(substring(body, source_char_start + 1, source_char_end - source_char_start), 400)")
    return c.join(docs, "doc_id").select("citation_row_id", (F.startswith(there, "quoted_text") | F.contains(there, "quoted_text")).alias("same")).groupBy("same").agg(F.count("*").alias("n"))


def fact_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.numeric_facts(_ok(_traces(spark, d)).select(*KEY, "answer"), _facts(spark, d)))


#: Required facts of one question, asked of every answer: each kind of matcher, alone and nested.
REQUIRED = [
    {"matcher": {"kind": "literal", "value": "subscription"}},
    {"matcher": {"kind": "literal", "value": "Record", "case_sensitive": True}, "weight": 0.5},
    {"matcher": {"kind": "numeric", "value": 30, "tolerance": 5}, "weight": 2.0},
    {"matcher": {"kind": "regex", "pattern": r"[0-9]+ (?:minutes|hours|days)"}},
    {"matcher": {"kind": "any_of", "matchers": [{"kind": "literal", "value": "export"}, {"kind": "literal", "value": "import"}]}},
    {"matcher": {"kind": "all_of", "matchers": [{"kind": "literal", "value": "the"}, {"kind": "absent", "matcher": {"kind": "regex", "pattern": "[Nn]ot", "flags": ""}}]}},
]


def required_facts(spark: SparkSession, d: str) -> DataFrame:
    """The weighted share of REQUIRED that each answer holds, and which of them."""
    answer = F.col("answer")
    held = F.concat_ws("", *[F.when(compile_matcher(f["matcher"], answer), "1").otherwise("0") for f in REQUIRED])
    return rounded(_ok(_traces(spark, d)).select(*KEY, matched_share(REQUIRED, answer).alias("required_fact_coverage"), held.alias("held")))


def forbidden_claims(spark: SparkSession, d: str) -> DataFrame:
    claims = _spans(spark, d).where("case_id IS NOT NULL AND NOT coalesce(authoritative, false)").select("case_id", F.col("quote").alias("claim"))
    return A.forbidden_claims(_ok(_traces(spark, d)).select(*KEY, "answer"), claims)


def case_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every metric of every case of every run, one wide row each.  What several metrics read is written once."""
    t = materialise(_traces(spark, d))
    claims = _spans(spark, d).where("case_id IS NOT NULL AND NOT coalesce(authoritative, false)").select("case_id", F.col("quote").alias("claim"))
    got = materialise(_retrieved(spark, d).select(*KEY, "rank", "chunk_id", "doc_id", "char_start", "char_end"))
    labels = t.select(*KEY, F.explode("context_labels").alias("label", "chunk_id"))
    return rounded(A.score(t, _spans(spark, d), got, _expected(spark, d), _facts(spark, d), claims, labels).drop("errors"))


# --- summaries and comparisons ---


def _light(spark: SparkSession, d: str) -> DataFrame:
    """Per case: category, pipeline, recall at 5, mrr, and whether the behaviour was right."""
    t = _ok(_traces(spark, d))
    m = retrieval_metrics(spark, d).select(*KEY, "recall_at_5", "mrr")
    a = A.abstention(t).select(*KEY, "correct")
    return t.select(*KEY, "pipeline_name", "category", "latency_ms", "ingested_at").join(m, KEY).join(a, KEY)


METRICS = ["recall_at_5", "mrr", "correct"]


def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.summarise(_light(spark, d), ["pipeline_name"], METRICS))


ALL_METRICS = [
    *(f"recall_at_{k}" for k in A.KS), "precision_at_5", "mrr", "document_recall", "required_fact_coverage", "forbidden_claims", "abstention_correct", "citation_validity", "citation_precision_doc", "claim_citation_coverage",
    "distinct_docs_cited",
]


def metric_summary_all(spark: SparkSession, d: str) -> DataFrame:
    """Every metric by pipeline: over how many cases it is defined, and its mean there.  Failed runs do not count."""
    scores = case_scores(spark, d)
    own = _ok(_traces(spark, d)).select(*KEY, "pipeline_name")
    return rounded(G.summarise(own.join(scores, KEY), ["pipeline_name"], ALL_METRICS))


def per_category_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Each category and all of them (null), in one pass."""
    return _light(spark, d).rollup("category").agg(F.count("*").alias("n"), r6(F.avg("recall_at_5")).alias("recall_at_5"), r6(F.avg("mrr")).alias("mrr"), r6(F.avg(F.col("correct").cast("int"))).alias("accuracy"), F.grouping("category").cast("int").alias("is_all"))


def latency_order_stats(spark: SparkSession, d: str) -> DataFrame:
    t = _ok(_traces(spark, d))
    stats = G.order_statistics(t, ["pipeline_name"], "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    means = t.groupBy("pipeline_name").agg(r6(F.avg("latency_ms")).alias("mean_ms"), r6(F.avg(F.col("cache_hit").cast("int"))).alias("cache_hit_rate"))
    return stats.join(means, "pipeline_name").select("pipeline_name", "n", "p50_ms", "p95_ms", "mean_ms", "cache_hit_rate")


def token_totals(spark: SparkSession, d: str) -> DataFrame:
    return _ok(_traces(spark, d)).groupBy("pipeline_name").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")])


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    t = _traces(spark, d)
    failed = F.coalesce(F.size("errors"), F.lit(0)) > 0
    return t.groupBy("run_id", "pipeline_name").agg(F.count("*").alias("n_cases"), F.count(F.when(failed, 1)).alias("n_errors"), F.countDistinct("category").alias("n_categories"), F.min("top_k").alias("top_k"), F.count(F.when(F.size("unresolved_labels") > 0, 1)).alias("n_with_unresolved"))


def _two_arms(spark: SparkSession, d: str) -> DataFrame:
    return materialise(_light(spark, d).where("pipeline_name IN ('baseline', 'improved')"))


def _arm(light: DataFrame, name: str) -> DataFrame:
    """The last run of each case in a pipeline."""
    rows = light.where(F.col("pipeline_name") == name)
    return M.latest(rows, ["case_id"], [F.col("ingested_at").desc_nulls_last(), F.col("run_id").desc()])


def _pairs(light: DataFrame) -> DataFrame:
    return materialise(G.pair(_arm(light, "baseline"), _arm(light, "improved"), METRICS))


def paired_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Paired means by category over the cases that both arms define."""
    light = _two_arms(spark, d)
    cats = _arm(light, "baseline").select("case_id", "category")
    return _pairs(light).join(cats, "case_id").groupBy("metric", "category").agg(F.count("*").alias("n"), r6(F.avg("baseline")).alias("baseline"), r6(F.avg("improved")).alias("improved"), r6(F.avg(F.col("improved") - F.col("baseline"))).alias("delta"))


def paired_bootstrap_exact(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.compare_exact(_pairs(_two_arms(spark, d))))


def paired_bootstrap_poisson(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.compare_poisson(_pairs(_two_arms(spark, d))))


def ablation_grid(spark: SparkSession, d: str) -> DataFrame:
    """Variants (kind of retrieval, budget) against metrics and latency, with the name of each variant."""
    t = _ok(_traces(spark, d)).select(*KEY, "retrieval_kind", "top_k", "latency_ms")
    m = materialise(t.join(retrieval_metrics(spark, d), KEY))
    by = ["retrieval_kind", "top_k"]
    grid = m.groupBy(*by).agg(F.count("*").alias("n"), *[r6(F.avg(c)).alias(c) for c in ("recall_at_1", "recall_at_5", "recall_at_10", "mrr", "precision_at_5")], r6(F.avg("latency_ms")).alias("mean_latency_ms"), r6(F.max("latency_ms")).alias("max_latency_ms"))
    middle = G.order_statistics(m, by, "latency_ms", {"low": 0.5 - 1e-12, "high": 0.5}).select(*[F.col(c).alias(f"_{c}") for c in by], r6((F.col("low") + F.col("high")) / 2).alias("median_latency_ms"))
    both = grid.join(middle, F.col("retrieval_kind").eqNullSafe(F.col("_retrieval_kind")) & F.col("top_k").eqNullSafe(F.col("_top_k")), "left").drop("_retrieval_kind", "_top_k")
    return both.withColumn("variant", F.concat_ws(" k=", "retrieval_kind", "top_k"))


def ablation_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Change of each kind of retrieval from the dense one, over all budgets."""
    m = _ok(_traces(spark, d)).select(*KEY, "retrieval_kind").join(retrieval_metrics(spark, d), KEY)
    long = materialise(G.summarise(m, ["retrieval_kind"], ["recall_at_5", "mrr", "precision_at_5"]).select("retrieval_kind", "metric", F.col("mean").alias("value")))
    return rounded(G.deltas(long, "retrieval_kind", "dense").select("retrieval_kind", "metric", "value", "delta"))


def ablation_budgets(spark: SparkSession, d: str) -> DataFrame:
    """Within each kind of retrieval, change of every budget from the smallest: what more context gives, all else equal."""
    t = _ok(_traces(spark, d)).where("retrieval_kind IS NOT NULL AND top_k IS NOT NULL").select(*KEY, "retrieval_kind", "top_k")
    m = t.join(retrieval_metrics(spark, d), KEY)
    long = materialise(G.summarise(m, ["retrieval_kind", "top_k"], ["recall_at_5", "recall_at_10", "mrr", "precision_at_5"]))
    least = long.groupBy("retrieval_kind").agg(F.min("top_k").alias("base_k"))
    base = long.join(least, "retrieval_kind").where("top_k = base_k").select("retrieval_kind", "metric", "base_k", F.col("mean").alias("base"))
    both = long.join(base, ["retrieval_kind", "metric"])
    return rounded(both.select("retrieval_kind", "metric", "base_k", "top_k", "n", F.col("mean").alias("value"), (F.col("mean") - F.col("base")).alias("delta")))


# --- failures ---


def _classified(spark: SparkSession, d: str) -> DataFrame:
    t = materialise(_traces(spark, d))
    retrieved = materialise(_retrieved(spark, d).select(*KEY, "rank", "chunk_id", "doc_id", "char_start", "char_end"))
    want, got = _expected(spark, d), retrieved.select(*KEY, "doc_id").distinct()
    met = got.join(want, ["case_id", "doc_id"]).select(*KEY).distinct().withColumn("met_docs", F.lit(True))
    any_ = got.select(*KEY).distinct().withColumn("any_docs", F.lit(True))
    exp = want.select("case_id").distinct().withColumn("expects_docs", F.lit(True))
    light = A.abstention(t).withColumnsRenamed({"expected": "abstention_expected", "observed": "abstention_observed", "correct": "abstention_correct"})
    facts = A.numeric_facts(t.select(*KEY, "answer"), _facts(spark, d))
    claims = _spans(spark, d).where("case_id IS NOT NULL AND NOT coalesce(authoritative, false)").select("case_id", F.col("quote").alias("claim"))
    forb = A.forbidden_claims(t.select(*KEY, "answer"), claims)
    own = materialise(A.claims(t))
    bound = A.bind_citations(own, t.select(*KEY, F.explode("context_labels").alias("label", "chunk_id")), retrieved)
    cited = A.citation_metrics(t.select(*KEY), own, materialise(bound), want).select(*KEY, "n_fabricated", "claim_citation_coverage")
    m = A.retrieval_metrics(t.select(*KEY), _spans(spark, d), retrieved, ks=(5,)).select(*KEY, "recall_at_5")
    out = t.select(*KEY, "category", "answerable", "errors")
    for part in (light, facts, forb, cited, m, met, any_):
        out = out.join(part, KEY, "left")
    return X.classify(out.join(exp, "case_id", "left"))


def taxonomy_classify(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).withColumn("secondary", F.array_join("secondary", ","))


def taxonomy_counts(spark: SparkSession, d: str) -> DataFrame:
    return X.counts(_classified(spark, d))


# --- checks across tables, cache ---


def validate_case_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that evidence names and the corpus lacks, with the number of spans."""
    spans = _spans(spark, d)
    return V.missing_keys(spans, table(spark, d, "corpus_docs").select("doc_id"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_spans"))


def validate_unknown_chunks(spark: SparkSession, d: str) -> DataFrame:
    return V.missing_keys(_retrieved(spark, d), table(spark, d, "chunks").select("chunk_id"), "chunk_id").groupBy("chunk_id").agg(F.count("*").alias("n"))


def validate_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Keys delivered more than once, per table."""
    one = lambda name, keys: V.duplicates(table(spark, d, name), keys).agg(F.count("*").alias("n_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")).select(F.lit(name).alias("table"), "n_keys", "n_rows")
    return one("traces", KEY).unionByName(one("retrieved", [*KEY, "rank"])).unionByName(one("citations", ["citation_row_id"])).unionByName(one("evidence_spans", ["span_row_id"]))


def validate_split_stratified(spark: SparkSession, d: str) -> DataFrame:
    t = _traces(spark, d).where("split IS NOT NULL")
    cases = t.select("case_id", "category", "split").distinct()
    return cases.groupBy("category").agg(F.count("*").alias("n_cases"), *[F.count(F.when(F.col("split") == s, 1)).alias(f"n_{s}") for s in ("train", "dev", "test")])


def validate_case_schema(spark: SparkSession, d: str) -> DataFrame:
    """Cases as their last trace row has them against the rules of a case, by rule and category."""
    last = M.latest(_traces(spark, d), ["case_id"], [F.col("ingested_at").desc_nulls_last(), F.col("run_id").desc_nulls_last()])
    per_case = _spans(spark, d).where("case_id IS NOT NULL").groupBy("case_id").agg(F.count("*").alias("n_spans"), F.countDistinct("doc_id").alias("n_documents"))
    named = last.select("case_id", "category", F.col("query").alias("question"), "answerable", "expected_behaviour", "split", F.when(F.col("answerable"), F.col("answer")).alias("reference_answer"), F.when(~F.col("answerable"), F.col("dataset_id")).alias("gap_id"))
    formed = named.join(per_case, "case_id", "left").fillna({"n_spans": 0, "n_documents": 0})
    return V.case_schema(formed).groupBy("problem").agg(F.count("*").alias("n"))


#: A category that cases should have, besides the fixed ones.
WANTED = {"comparison": 1}


def validate_distribution(spark: SparkSession, d: str) -> DataFrame:
    cases = _traces(spark, d).where("split IS NOT NULL AND case_id IS NOT NULL").select("case_id", "category", "split").distinct()
    return V.distribution(cases, V.LEAST_CASES | WANTED)


def validate_undeclared(spark: SparkSession, d: str) -> DataFrame:
    """Ids that evidence and citations name and no table declares, by kind: documents as facts, chunks as chains."""
    ids = lambda kind, df, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("id"))
    used = lambda kind, df, c: df.select("case_id", F.lit(kind).alias("kind"), F.col(c).alias("id"))
    named = used("fact", _spans(spark, d), "doc_id").unionByName(used("chain", M.citations(table(spark, d, "citations")), "chunk_id"))
    declared = ids("fact", table(spark, d, "corpus_docs"), "doc_id").unionByName(ids("chain", table(spark, d, "chunks"), "chunk_id"))
    return V.undeclared(named, declared).groupBy("kind", "id").agg(F.count("*").alias("n"))


def validate_unanswerable(spark: SparkSession, d: str) -> DataFrame:
    """Unanswerable cases whose gap is not declared, or whose gap the corpus fills: by gap, term and document."""
    cases = _traces(spark, d).where("case_id IS NOT NULL").select("case_id", "answerable", F.col("category").alias("gap_id")).distinct()
    docs = M.documents(table(spark, d, "corpus_docs"))
    return V.unanswerable(cases, docs, GAPS).groupBy("gap_id", "term", "doc_id").agg(F.count("*").alias("n_cases"))


def validate_superseded_values(spark: SparkSession, d: str) -> DataFrame:
    """Versions that a document or the one it supersedes should name and does not."""
    docs = M.documents(table(spark, d, "corpus_docs"))
    one = lambda side, doc: docs.where("supersedes IS NOT NULL").select(F.col("doc_id").alias("id"), F.lit(side).alias("side"), F.col("version").alias("value"), F.col(doc).alias("doc_id"))
    return V.superseded_values(one("current", "doc_id").unionByName(one("previous", "supersedes")), docs)


def validate_quote_ids(spark: SparkSession, d: str) -> DataFrame:
    """Citations whose quoted text is not the whole text of the chunk that they name, going by its id."""
    c = M.citations(table(spark, d, "citations")).where("quoted_text IS NOT NULL AND chunk_id IS NOT NULL AND doc_id IS NOT NULL")
    return c.where(T.content_id("doc_id", "quoted_text") != F.col("chunk_id")).select("citation_row_id", "chunk_id")


def cache_hit_miss(spark: SparkSession, d: str) -> DataFrame:
    """Requests (query and configuration) of each pipeline that an earlier run of any pipeline has answered."""
    t = _ok(_traces(spark, d)).where("query IS NOT NULL").select("pipeline_name", F.sha2(F.concat_ws("|", "config_hash", "query"), 256).alias("key"), "ingested_at")
    first = t.groupBy("key").agg(F.min("ingested_at").alias("first"))
    return t.join(first, "key").groupBy("pipeline_name").agg(F.count("*").alias("n"), F.count(F.when(F.col("ingested_at") > F.col("first"), 1)).alias("n_hits"))


def judged_precision(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of retrieval: judged rows at rank 5 or better, their mean grade, and the share of grade 2 or 3."""
    t = _traces(spark, d).select(*KEY, "retrieval_kind")
    j = _retrieved(spark, d).where("rank <= 5").join(table(spark, d, "judgments"), ["case_id", "chunk_id"]).join(t, KEY)
    return j.groupBy("retrieval_kind").agg(F.count("*").alias("n"), r6(F.avg("grade")).alias("mean_grade"), r6(F.avg((F.col("grade") >= 2).cast("int"))).alias("share_relevant"))


def score_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Per run: how many of each score there are, NaN left out, and their range."""
    r = _retrieved(spark, d)
    ok = lambda c: F.when(~F.isnan(c), F.col(c))
    return r.groupBy("run_id").agg(*[x for c in ("dense_score", "lexical_score", "rrf_score", "rerank_score") for x in (F.count(ok(c)).alias(f"n_{c}"), r6(F.min(ok(c))).alias(f"min_{c}"), r6(F.max(ok(c))).alias(f"max_{c}"))])


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows of `events` by type: number and sum; what the stream of the same name gives."""
    from ..streaming.windows import hourly

    return hourly(table(spark, d, "events"))


QUERIES = {
    f.__name__: f
    for f in (
        retrieval_scorecard, bm25_idf, bm25_topk, dense_topk_exact, dense_label_precision, embedding_norms, rrf_fusion, dedup_greedy, context_pack, span_coverage, retrieval_metrics, ndcg_at_10, document_recall, budget_metrics,
        abstention_detect, abstention_confusion, detector_agreement, strip_labels, extract_labels, split_claims, bind_citations, bind_labels, citation_metrics, recorded_citations, citation_quotes, fact_coverage, required_facts, forbidden_claims, case_scores,
        metric_summary, metric_summary_all, per_category_rollup, latency_order_stats, token_totals, run_summary, paired_comparison, paired_bootstrap_exact, paired_bootstrap_poisson, ablation_grid, ablation_deltas, ablation_budgets, taxonomy_classify, taxonomy_counts,
        validate_case_documents, validate_unknown_chunks, validate_duplicates, validate_split_stratified, validate_case_schema, validate_distribution, validate_undeclared, validate_unanswerable, validate_superseded_values, validate_quote_ids, cache_hit_miss, judged_precision, score_ranges, event_windows,
    )
}
from .evaluation_sql import GAPS, ORACLES  # noqa: E402, F401
