"""One failure class per failed case, by ordered rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Every class, in the order of reports.  Fixed values.
CLASSES = [
    "retrieval_miss",
    "retrieval_partial_multihop",
    "evidence_ranked_low",
    "retrieval_distractor",
    "policy_version_confusion",
    "aggregation_error",
    "incomplete_answer",
    "unsupported_claim",
    "failed_abstention",
    "over_abstention",
    "ambiguity_collapse",
    "citation_missing",
    "citation_unresolvable",
    "format_violation",
    "pipeline_error",
]
#: Categories that need several places; fixed values.
SEVERAL_HOPS = ["multi_hop", "aggregation", "citation_stress"]


def classify(scored: DataFrame, k: int = 5, min_fact_coverage: float = 0.999) -> DataFrame:
    """(run_id, case_id, failed, primary, secondary) of rows as ``metrics.score`` makes them.

    Needs also expects_docs and met_docs (booleans: an expected document exists; one was retrieved) and
    any_docs (something was retrieved).  A rule on an undefined metric does not fire.
    """
    c = F.col
    no = lambda x: F.coalesce(x, F.lit(False))
    recall, cover, claim = c(f"recall_at_{k}"), c("required_fact_coverage"), c("claim_citation_coverage")
    errors = no(F.size("errors") > 0)
    expected, observed = c("abstention_expected"), c("abstention_observed")
    wrong = ~no(expected.eqNullSafe(observed))
    forbidden, fabricated = no(c("forbidden_claims") > 0), no(c("n_fabricated") > 0)
    uncited = no(claim < 0.5)
    failed = errors | no(~c("abstention_correct")) | (no(c("answerable")) & (no(cover < min_fact_coverage) | no(recall < 1.0) | fabricated | forbidden))
    miss, part = no(recall <= 0), no((recall > 0) & (recall < 1))
    rules = [
        (errors, "pipeline_error"),
        (miss, "retrieval_miss"),
        (part & c("category").isin(SEVERAL_HOPS), "retrieval_partial_multihop"),
        (part, "evidence_ranked_low"),
        (wrong & (expected == "abstain"), "failed_abstention"),
        (wrong & (expected == "clarify"), "ambiguity_collapse"),
        (wrong & (expected == "answer") & (observed == "abstain"), "over_abstention"),
        ((c("category") == "temporal") & forbidden, "policy_version_confusion"),
        (fabricated, "citation_unresolvable"),
        (forbidden, "unsupported_claim"),
        (no(cover < 1) & (c("category") == "aggregation"), "aggregation_error"),
        (no(cover < 1), "incomplete_answer"),
        (uncited, "citation_missing"),
    ]
    primary = F.when(F.lit(False), F.lit(""))
    for rule, name in rules:
        primary = primary.when(no(rule), name)
    primary = primary.otherwise("format_violation")
    late = ["unsupported_claim", "aggregation_error", "incomplete_answer", "format_violation"]
    out = scored.select("run_id", "case_id", "category", failed.alias("failed"), F.when(failed, primary).alias("primary"), "expects_docs", "met_docs", "any_docs", uncited.alias("_uncited"))
    distractor = (c("primary") == "retrieval_miss") & no(c("expects_docs")) & ~no(c("met_docs")) & no(c("any_docs"))
    second = F.when(no(distractor), F.array(F.lit("retrieval_distractor"))).when(no(c("primary").isin(late)) & c("_uncited"), F.array(F.lit("citation_missing"))).otherwise(F.array().cast("array<string>"))
    return out.select("run_id", "case_id", "category", "failed", "primary", second.alias("secondary"))


def counts(classified: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., class, n) for every class, zeros included."""
    by = by or []
    each = classified.where("failed").groupBy(*by, F.col("primary").alias("class")).agg(F.count("*").alias("n"))
    groups = classified.select(*by).distinct() if by else classified.sparkSession.range(1).select()
    every = groups.select(*by, F.explode(F.array(*[F.lit(x) for x in CLASSES])).alias("class"))
    return every.join(each, [*by, "class"], "left").select(*by, "class", F.coalesce("n", F.lit(0)).alias("n"))
