"""Metrics per (run_id, case_id).  An undefined metric is NULL, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import materialise
from ..functions import spans as S
from ..functions import text as T

KEY = ["run_id", "case_id"]
KS = (1, 3, 5, 10)


def resolvable(spans: DataFrame) -> DataFrame:
    """(case_id, span_id, doc_id, char_start, char_end) of the spans that have a place."""
    return spans.where("char_start >= 0 AND case_id IS NOT NULL").select("case_id", "span_id", "doc_id", F.col("char_start").alias("s"), F.col("char_end").alias("e"))


def relevance(spans: DataFrame, retrieved: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(run_id, case_id, span_id, rank, coverage): which retrieved chunks cover which evidence spans.

    An equi-join on case and document with the interval test as a condition; a span is covered when the
    chunk holds *threshold* of it.
    """
    own = resolvable(spans)
    r = retrieved.select("run_id", "case_id", "rank", "doc_id", F.col("char_start").alias("rs"), F.col("char_end").alias("re"))
    covered = S.coverage_fraction(F.col("s"), F.col("e"), F.col("rs"), F.col("re"))
    return r.join(own, ["case_id", "doc_id"]).select("run_id", "case_id", "span_id", "rank", covered.alias("coverage")).where(F.col("coverage") >= threshold)


def retrieval_metrics(cases: DataFrame, spans: DataFrame, retrieved: DataFrame, threshold: float = 0.5, ks: tuple[int, ...] = KS) -> DataFrame:
    """recall_at_k, precision_at_k and mrr of every row of cases(run_id, case_id).

    A span counts once in recall however many chunks cover it; a chunk counts once in precision however
    many spans it covers; precision is over the chunks there are, not over k.  Without resolvable spans all
    are NULL; with spans and nothing retrieved all are 0.  mrr has no cut-off.
    """
    hit = F.collect_list(F.struct("span_id", "rank")).alias("hits")
    lists = relevance(spans, retrieved, threshold).groupBy(*KEY).agg(hit, F.min("rank").alias("best"))
    # one retrieval's hits are few: both counts are taken from one list
    upto = lambda k, c: F.size(F.array_distinct(F.transform(F.filter("hits", lambda x: x["rank"] <= k), lambda x: x[c])))
    found = lists.select(*KEY, "best", *[upto(k, "span_id").alias(f"_found_{k}") for k in ks], *[upto(k, "rank").alias(f"_rel_{k}") for k in ks])
    shown = retrieved.groupBy(*KEY).agg(*[F.count(F.when(F.col("rank") <= k, 1)).alias(f"_top_{k}") for k in ks])
    total = resolvable(spans).groupBy("case_id").agg(F.count("*").alias("n_spans"))
    all_ = cases.join(total, "case_id", "left").join(found, KEY, "left").join(shown, KEY, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    has = F.col("n_spans").isNotNull()
    return all_.select(
        *KEY,
        *[F.when(has, zero(f"_found_{k}") / F.col("n_spans")).alias(f"recall_at_{k}") for k in ks],
        *[F.when(has, F.when(zero(f"_top_{k}") > 0, zero(f"_rel_{k}") / F.col(f"_top_{k}")).otherwise(0.0)).alias(f"precision_at_{k}") for k in ks],
        F.when(has, F.coalesce(1.0 / F.col("best"), F.lit(0.0))).alias("mrr"),
    )


def ndcg(cases: DataFrame, spans: DataFrame, retrieved: DataFrame, k: int = 10, threshold: float = 0.5) -> DataFrame:
    """(run_id, case_id, ndcg): greedy one-to-one matching in rank order; kept for old reports only.

    Each chunk earns once, with the span it covers most (then the first span); each span is earned once.
    The matching is a fold over the hits of one case, in the JVM.
    """
    hit = F.struct("rank", (-F.col("coverage")).alias("less"), "span_id")
    lists = relevance(spans, retrieved, threshold).where(F.col("rank") <= k).groupBy(*KEY).agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    rank_kind, span_kind = dict(retrieved.dtypes)["rank"], dict(spans.dtypes)["span_id"]
    start = F.struct(F.array().cast(f"array<{rank_kind}>").alias("ranks"), F.array().cast(f"array<{span_kind}>").alias("spans"))

    def take(acc: Column, x: Column) -> Column:
        used = F.array_contains(acc["ranks"], x["rank"]) | F.array_contains(acc["spans"], x["span_id"])
        both = F.struct(F.concat(acc["ranks"], F.array(x["rank"])).alias("ranks"), F.concat(acc["spans"], F.array(x["span_id"])).alias("spans"))
        return F.when(used, acc).otherwise(both)

    matched = F.aggregate("hits", start, take, lambda acc: acc["ranks"])
    dcg = F.aggregate(matched, F.lit(0.0), lambda a, r: a + 1.0 / F.log2(r + 1.0))
    gains = lists.select(*KEY, dcg.alias("dcg"))
    total = resolvable(spans).groupBy("case_id").agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    return cases.join(total, "case_id", "left").join(gains, KEY, "left").select(*KEY, F.when(F.col("n").isNotNull(), F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def document_recall(cases: DataFrame, expected: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(run_id, case_id, document_recall): share of the rows of expected(case_id, doc_id) that were retrieved.
    A document listed twice counts twice; NULL where none is expected."""
    seen = retrieved.select(*KEY, "doc_id").distinct().withColumn("seen", F.lit(1))
    wanted = cases.join(expected.select("case_id", "doc_id"), "case_id").join(seen, [*KEY, "doc_id"], "left")
    share = wanted.groupBy(*KEY).agg((F.count("seen") / F.count("*")).alias("document_recall"))
    return cases.join(share, KEY, "left").select(*KEY, "document_recall")


def abstention(traces: DataFrame) -> DataFrame:
    """(run_id, case_id, expected, observed, correct): abstaining comes before asking back.  A null answer was no answer: NULL."""
    observed = F.when(F.col("answer").isNotNull(), T.observed_behaviour(T.detect_abstention("answer"), T.detect_clarification("answer")))
    return traces.select(*KEY, F.col("expected_behaviour").alias("expected"), observed.alias("observed"), (observed == F.col("expected_behaviour")).alias("correct"))


def claims(traces: DataFrame) -> DataFrame:
    """(run_id, case_id, claim_id, text, char_start, char_end, cited_labels): one row per claim of an answer."""
    return traces.where("answer IS NOT NULL").select(*KEY, F.explode(T.split_claims("answer")).alias("c")).select(*KEY, "c.*")


def bind_citations(claims: DataFrame, labels: DataFrame, retrieved: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """One row per (claim, label): where the label leads.  A label that leads nowhere is a row with
    resolved = false, never dropped.

    claims(run_id, case_id, claim_id, cited_labels), labels(run_id, case_id, label, chunk_id),
    retrieved(run_id, case_id, chunk_id, doc_id, char_start, char_end, rank); bodies(doc_id, body) for the
    quoted text, at most 400 code points.  A chunk retrieved twice is taken where it ranks last.
    """
    each = claims.select(*KEY, "claim_id", F.posexplode("cited_labels").alias("pos", "label"))
    place = F.max(F.struct("rank", "doc_id", "char_start", "char_end")).alias("p")
    chunks = retrieved.where("chunk_id IS NOT NULL").groupBy(*KEY, "chunk_id").agg(place).select(*KEY, "chunk_id", "p.doc_id", F.col("p.char_start").alias("source_char_start"), F.col("p.char_end").alias("source_char_end"))
    known = labels.join(chunks, [*KEY, "chunk_id"])
    out = each.join(known, [*KEY, "label"], "left").withColumn("resolved", F.col("chunk_id").isNotNull())
    if bodies is not None:
        quoted = F.expr("left(substring(body, source_char_start + 1, source_char_end - source_char_start), 400)")
        out = out.join(bodies.select("doc_id", "body"), "doc_id", "left").withColumn("quoted_text", quoted).drop("body")
    return out


def citation_metrics(cases: DataFrame, claims: DataFrame, citations: DataFrame, expected: DataFrame) -> DataFrame:
    """Numbers of citations, resolved and fabricated ones; validity, precision by document, share of the
    substantive claims (four words or more) with a citation, distinct documents cited.  Shares over nothing
    are NULL, counts over nothing 0.  A fabricated label is a citation of its claim too."""
    want = expected.select("case_id", "doc_id").where("doc_id IS NOT NULL").distinct()
    marked = citations.join(want.withColumn("on_target", F.lit(1)), ["case_id", "doc_id"], "left")
    per = marked.groupBy(*KEY).agg(
        F.count("*").alias("n_citations"),
        F.count(F.when(F.col("resolved"), 1)).alias("n_resolved"),
        F.count(F.when(F.col("resolved") & F.col("on_target").isNotNull(), 1)).alias("_hit"),
        F.countDistinct(F.when(F.col("resolved"), F.col("doc_id"))).alias("distinct_docs_cited"),
    )
    cited = citations.select(*KEY, "claim_id").distinct().withColumn("cited", F.lit(1))
    substantive = claims.where(T.word_count("text") >= 4).join(cited, [*KEY, "claim_id"], "left")
    cover = substantive.groupBy(*KEY).agg((F.count("cited") / F.count("*")).alias("claim_citation_coverage"))
    number = claims.groupBy(*KEY).agg(F.count("*").alias("n_claims"))
    known = want.select("case_id").distinct().withColumn("expects", F.lit(True))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    out = cases.join(per, KEY, "left").join(cover, KEY, "left").join(number, KEY, "left").join(known, "case_id", "left")
    return out.select(
        *KEY,
        zero("n_citations").alias("n_citations"),
        zero("n_resolved").alias("n_resolved"),
        (zero("n_citations") - zero("n_resolved")).alias("n_fabricated"),
        F.when(zero("n_citations") > 0, zero("n_resolved") / zero("n_citations")).alias("citation_validity"),
        F.when((zero("n_resolved") > 0) & F.col("expects"), zero("_hit") / zero("n_resolved")).alias("citation_precision_doc"),
        "claim_citation_coverage",
        zero("distinct_docs_cited").alias("distinct_docs_cited"),
        zero("n_claims").alias("n_claims"),
    )


def numeric_facts(cases: DataFrame, facts: DataFrame) -> DataFrame:
    """(run_id, case_id, required_fact_coverage): weighted share of the rows of facts(case_id, value, weight)
    whose value is among the numbers of cases(run_id, case_id, answer); NULL without facts or weight."""
    numbers = cases.select(*KEY, T.numbers_in(F.coalesce("answer", F.lit(""))).alias("ns"))
    close = F.exists("ns", lambda n: F.abs(n - F.col("value")) <= F.abs(F.col("value")) * 1e-9)
    per = numbers.join(facts.select("case_id", "value", "weight"), "case_id").groupBy(*KEY).agg(F.sum("weight").alias("total"), F.sum(F.when(close, F.col("weight")).otherwise(0.0)).alias("hit"))
    return cases.select(*KEY).join(per, KEY, "left").select(*KEY, F.when(F.col("total") > 0, F.col("hit") / F.col("total")).alias("required_fact_coverage"))


def forbidden_claims(cases: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(run_id, case_id, forbidden_claims): how many rows of forbidden(case_id, claim) show in the answer, by
    the first amount, code or date offset of the claim; claims without one never count."""
    token = T.claim_token("claim").alias("token")
    rows = forbidden.select("case_id", token).where("token IS NOT NULL")
    per = cases.select(*KEY, F.lower("answer").alias("low")).join(rows, "case_id").where(F.contains("low", "token")).groupBy(*KEY).agg(F.count("*").alias("n"))
    return cases.select(*KEY).join(per, KEY, "left").select(*KEY, F.coalesce("n", F.lit(0)).alias("forbidden_claims"))


def score(traces: DataFrame, spans: DataFrame, retrieved: DataFrame, expected: DataFrame, facts: DataFrame, forbidden: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """All metrics of every row of traces, one wide row per (run_id, case_id)."""
    cases = traces.select(*KEY)
    # the claims are found once: cutting answers is the slow part
    own = materialise(claims(traces))
    cites = materialise(bind_citations(own, labels, retrieved))
    parts = [
        retrieval_metrics(cases, spans, retrieved, threshold),
        document_recall(cases, expected, retrieved),
        numeric_facts(traces.select(*KEY, "answer"), facts),
        forbidden_claims(traces.select(*KEY, "answer"), forbidden),
        abstention(traces).withColumnsRenamed({"expected": "abstention_expected", "observed": "abstention_observed", "correct": "abstention_correct"}),
        citation_metrics(cases, own, cites, expected),
    ]
    out = traces.select(*KEY, "category", "answerable", "errors")
    for part in parts:
        out = out.join(part, KEY, "left")
    return out
