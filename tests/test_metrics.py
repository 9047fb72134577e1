import math
import random

import pytest
from pyspark.sql import functions as F

from spanwise.operators import metrics as A
from spanwise.operators import taxonomy as X

SPANS = "case_id string, span_id int, doc_id string, char_start int, char_end int"
GOT = "run_id string, case_id string, rank int, chunk_id string, doc_id string, char_start int, char_end int"


@pytest.fixture
def small(spark):
    cases = spark.createDataFrame([("r", c) for c in ("one", "two", "none", "empty", "unplaced")], "run_id string, case_id string")
    spans = spark.createDataFrame([("one", 0, "a", 100, 200), ("two", 0, "a", 0, 100), ("two", 1, "a", 120, 220), ("empty", 0, "a", 0, 10), ("unplaced", 0, "a", -1, -1)], SPANS)
    got = spark.createDataFrame([("r", "one", 1, "k1", "a", 900, 1000), ("r", "one", 2, "k2", "b", 90, 250), ("r", "one", 3, "k3", "a", 90, 250), ("r", "two", 1, "k4", "a", 0, 300), ("r", "two", 2, "k5", "a", 0, 100), ("r", "none", 1, "k6", "a", 0, 9)], GOT)
    return cases, spans, got


def test_definitions_and_nulls(small):
    rows = {r.case_id: r for r in A.retrieval_metrics(*small).collect()}
    assert (rows["one"].recall_at_1, rows["one"].recall_at_3, rows["one"].mrr, rows["one"].precision_at_3) == (0, 1, pytest.approx(1 / 3), pytest.approx(1 / 3))
    assert (rows["two"].recall_at_1, rows["two"].precision_at_1, rows["two"].precision_at_10, rows["two"].mrr) == (1, 1, 1, 1)
    assert (rows["empty"].recall_at_10, rows["empty"].precision_at_10, rows["empty"].mrr) == (0, 0, 0)
    assert all(rows[c].recall_at_5 is None and rows[c].mrr is None and rows[c].precision_at_5 is None for c in ("none", "unplaced"))


def brute_ndcg(spans, got, k):
    free, ranks = {s[0]: s for s in spans}, []
    for rank, doc, a, z in sorted(got):
        if rank > k:
            break
        best = [((min(e, z) - max(s, a)) / (e - s), -i) for i, d, s, e in free.values() if d == doc and e > s and (min(e, z) - max(s, a)) / (e - s) >= 0.5]
        if best:
            del free[-max(best)[1]]
            ranks.append(rank)
    return sum(1 / math.log2(r + 1) for r in ranks) / sum(1 / math.log2(i + 2) for i in range(min(len(spans), k)))


def test_ndcg_matches_brute_force(spark):
    rnd = random.Random(1)
    spans = [(f"c{c}", i, rnd.choice("ab"), s, s + rnd.randint(5, 60)) for c in range(12) for i in range(rnd.randint(1, 4)) for s in [rnd.randint(0, 200)]]
    got = [("r", f"c{c}", i + 1, f"k{i}", rnd.choice("ab"), s, s + rnd.randint(20, 150)) for c in range(12) for i in range(8) for s in [rnd.randint(0, 200)]]
    cases = spark.createDataFrame([("r", f"c{c}") for c in range(13)], "run_id string, case_id string")
    rows = {r.case_id: r.ndcg for r in A.ndcg(cases, spark.createDataFrame(spans, SPANS), spark.createDataFrame(got, GOT), 5).collect()}
    assert rows.pop("c12") is None
    for c, v in rows.items():
        assert v == pytest.approx(brute_ndcg([s[1:] for s in spans if s[0] == c], [(g[2], g[4], g[5], g[6]) for g in got if g[1] == c], 5))


def test_document_recall_counts_repeats(small, spark):
    cases, _, got = small
    expected = spark.createDataFrame([("one", "a"), ("one", "z"), ("one", "z"), ("two", "a")], "case_id string, doc_id string")
    rows = {r.case_id: r.document_recall for r in A.document_recall(cases, expected, got).collect()}
    assert rows == {"one": pytest.approx(1 / 3), "two": 1.0, "none": None, "empty": None, "unplaced": None}


def test_citations(spark):
    traces = spark.createDataFrame([("r", "x", "The fee is five units [C1]. The limit is ten units [C9]. Ok.", {"C1": "k1", "C2": "gone"}), ("r", "y", "Nothing is cited here at all.", {}), ("r", "z", None, None)], "run_id string, case_id string, answer string, context_labels map<string,string>")
    got = spark.createDataFrame([("r", "x", 1, "k1", "d", 0, 5), ("r", "x", 2, "k2", "e", 0, 5)], GOT)
    claims = A.claims(traces)
    labels = traces.select("run_id", "case_id", F.explode("context_labels").alias("label", "chunk_id"))
    bodies = spark.createDataFrame([("d", "abcdefgh")], "doc_id string, body string")
    bound = A.bind_citations(claims, labels, got, bodies)
    assert {(r.claim_id, r.label, r.resolved, r.quoted_text) for r in bound.collect()} == {("cl0", "C1", True, "abcde"), ("cl1", "C9", False, None)}
    expected = spark.createDataFrame([("x", "d")], "case_id string, doc_id string")
    rows = {r.case_id: r for r in A.citation_metrics(traces.select("run_id", "case_id"), claims, bound, expected).collect()}
    x, y, z = rows["x"], rows["y"], rows["z"]
    assert (x.n_citations, x.n_resolved, x.n_fabricated, x.citation_validity, x.citation_precision_doc, x.claim_citation_coverage, x.n_claims) == (2, 1, 1, 0.5, 1.0, 1.0, 3)
    assert (y.n_citations, y.citation_validity, y.claim_citation_coverage) == (0, None, 0.0)
    assert (z.n_claims, z.claim_citation_coverage) == (0, None)


def test_facts_and_forbidden(spark):
    cases = spark.createDataFrame([("r", "a", "It is 47 units"), ("r", "b", None), ("r", "c", "0")], "run_id string, case_id string, answer string")
    facts = spark.createDataFrame([("a", 47.0, 1.0), ("a", 12.0, 3.0), ("b", 1.0, 1.0)], "case_id string, value double, weight double")
    assert {r.case_id: r.required_fact_coverage for r in A.numeric_facts(cases, facts).collect()} == {"a": 0.25, "b": 0.0, "c": None}
    bad = spark.createDataFrame([("a", "says 47 outright"), ("a", "no number"), ("a", "$9"), ("b", "1")], "case_id string, claim string")
    assert {r.case_id: r.forbidden_claims for r in A.forbidden_claims(cases, bad).collect()} == {"a": 1, "b": 0, "c": 0}


BASE = {"category": "factual", "answerable": True, "errors": [], "recall_at_5": 1.0, "required_fact_coverage": 1.0, "forbidden_claims": 0, "n_fabricated": 0, "claim_citation_coverage": 1.0, "abstention_expected": "answer", "abstention_observed": "answer", "abstention_correct": True, "expects_docs": True, "met_docs": True, "any_docs": True}
SCORED = "run_id string, case_id string, category string, answerable boolean, errors array<string>, recall_at_5 double, required_fact_coverage double, forbidden_claims int, n_fabricated int, claim_citation_coverage double, abstention_expected string, abstention_observed string, abstention_correct boolean, expects_docs boolean, met_docs boolean, any_docs boolean"
RULES = [
    ({}, None, []),
    ({"errors": ["x"]}, "pipeline_error", []),
    ({"recall_at_5": 0.0, "met_docs": False}, "retrieval_miss", ["retrieval_distractor"]),
    ({"recall_at_5": 0.0}, "retrieval_miss", []),
    ({"recall_at_5": 0.5, "category": "multi_hop"}, "retrieval_partial_multihop", []),
    ({"recall_at_5": 0.5}, "evidence_ranked_low", []),
    ({"abstention_expected": "abstain", "abstention_correct": False, "answerable": False, "recall_at_5": None}, "failed_abstention", []),
    ({"abstention_expected": "clarify", "abstention_correct": False}, "ambiguity_collapse", []),
    ({"abstention_observed": "abstain", "abstention_correct": False}, "over_abstention", []),
    ({"category": "temporal", "forbidden_claims": 1}, "policy_version_confusion", []),
    ({"n_fabricated": 1, "forbidden_claims": 1}, "citation_unresolvable", []),
    ({"forbidden_claims": 1, "claim_citation_coverage": 0.2}, "unsupported_claim", ["citation_missing"]),
    ({"required_fact_coverage": 0.5, "category": "aggregation"}, "aggregation_error", []),
    ({"required_fact_coverage": 0.5}, "incomplete_answer", []),
    ({"abstention_observed": "clarify", "abstention_correct": False, "claim_citation_coverage": 0.2}, "citation_missing", []),
    ({"abstention_observed": "clarify", "abstention_correct": False}, "format_violation", []),
    ({"answerable": False, "recall_at_5": 0.0, "forbidden_claims": 3}, None, []),
    ({"recall_at_5": None, "required_fact_coverage": None, "claim_citation_coverage": None}, None, []),
]


def test_failure_rules_in_order(spark):
    rows = [("r", f"{i:02d}", *(BASE | change).values()) for i, (change, _, _) in enumerate(RULES)]
    got = X.classify(spark.createDataFrame(rows, SCORED)).orderBy("case_id").collect()
    assert [(r.primary, r.secondary) for r in got] == [(p, s) for _, p, s in RULES]
    n = {r["class"]: r.n for r in X.counts(spark.createDataFrame(got)).collect()}
    assert set(n) == set(X.CLASSES) and n["retrieval_miss"] == 2 and n["retrieval_distractor"] == 0
