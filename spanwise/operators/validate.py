"""Checks: each returns the rows that violate it, none where all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.spans import resolve_quote

#: Keys that front matter must have; fixed values.
REQUIRED = ("doc_id", "title", "version", "effective_date")
#: Traces of text that was decoded with the wrong encoding.  Fixed values.
MOJIBAKE = ("â€", "Ã©", "Â ")


def front_matter(docs: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(doc_id, missing, not_synthetic, no_disclaimer) of documents that lack a key, a true `synthetic`, or a disclaimer."""
    missing = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in required]))
    out = docs.select("doc_id", F.array_join(missing, ",").alias("missing"), (~F.col("synthetic").eqNullSafe(F.lit(True))).alias("not_synthetic"), (F.coalesce(F.trim("disclaimer"), F.lit("")) == "").alias("no_disclaimer"))
    return out.where("missing <> '' OR not_synthetic OR no_disclaimer")


def encoding(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, has_bom, has_mojibake, has_replacement) of texts with a byte order mark, double encoding or lost bytes."""
    wrong = F.lit(False)
    for m in MOJIBAKE:
        wrong = wrong | F.contains(F.col(text), F.lit(m))
    out = df.where(F.col(text).isNotNull()).select(key, F.startswith(F.col(text), F.lit("﻿")).alias("has_bom"), wrong.alias("has_mojibake"), F.contains(F.col(text), F.lit("�")).alias("has_replacement"))
    return out.where("has_bom OR has_mojibake OR has_replacement")


def checksums(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, problem): recorded(path, recorded) that are MISSING in, or CHANGED from, actual(path, actual)."""
    both = recorded.where("recorded IS NOT NULL").join(actual, "path", "left")
    return both.select("path", F.when(F.col("actual").isNull(), "MISSING").when(F.col("actual") != F.col("recorded"), "CHANGED").alias("problem")).where("problem IS NOT NULL")


def gap_probes(docs: DataFrame, gaps: dict[str, list[str]]) -> DataFrame:
    """(gap_id, term, doc_id): documents that mention, as whole words, a term that must be nowhere.

    Terms are a short declared list: each becomes an expression, so the bodies are read once and nothing is joined.
    """
    found = [F.when(F.rlike("body", F.concat(F.lit(r"(?iU)\b\Q"), F.lit(t), F.lit(r"\E\b"))), F.struct(F.lit(g).alias("gap_id"), F.lit(t).alias("term"))) for g, ts in gaps.items() for t in ts]
    return docs.select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("x")).select("x.gap_id", "x.term", "doc_id")


def missing_keys(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose *key* is not null and not in *known*."""
    return rows.where(F.col(key).isNotNull()).join(known.select(key).distinct(), key, "left_anti")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n) of keys with several rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unresolved_quotes(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """(case_id, doc_id, quote): spans whose document exists but whose quote has no place in it."""
    placed = spans.join(docs.select("doc_id", "body"), "doc_id").withColumn("at", resolve_quote("body", "quote"))
    return placed.where("at IS NULL OR coalesce(at.char_start, -1) < 0").select("case_id", "doc_id", "quote")


def unjustified_documents(cases: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows of cases(case_id, doc_id) whose document no span of the case is in."""
    return cases.join(spans.select("case_id", "doc_id").distinct(), ["case_id", "doc_id"], "left_anti")


#: Least number of cases of each category, and of all; fixed values.
LEAST_CASES = {"factual": 10, "multi_hop": 5, "aggregation": 4, "unanswerable": 4, "ambiguous": 3, "temporal": 2, "citation_stress": 2}
LEAST_TOTAL = 30


def distribution(cases: DataFrame, least: dict[str, int], total: int = LEAST_TOTAL) -> DataFrame:
    """(category, n, n_splits, problem): categories with too few cases (or none), or several in one split only; and too few cases at all."""
    per = cases.groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("split").alias("n_splits"))
    wanted = cases.sparkSession.createDataFrame(list(least.items()), "category string, least int")
    own = per.join(F.broadcast(wanted), "category", "full").select("category", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_splits", F.lit(0)).alias("n_splits"), F.coalesce("least", F.lit(0)).alias("least"))
    few = F.when(F.col("n") < F.col("least"), "too few").when((F.col("n_splits") < 2) & (F.col("n") > 1), "one split")
    all_ = cases.agg(F.count("*").alias("n"), F.countDistinct("split").alias("n_splits")).select(F.lit("*").alias("category"), "n", "n_splits", F.when(F.col("n") < total, "too few").alias("problem"))
    return own.select("category", "n", "n_splits", few.alias("problem")).unionByName(all_).where("problem IS NOT NULL")


def undeclared(named: DataFrame, declared: DataFrame) -> DataFrame:
    """Rows of named(case_id, kind, id) whose id no row of declared(kind, id) has; null ids name nothing."""
    return named.where("id IS NOT NULL").join(declared.select("kind", "id").distinct(), ["kind", "id"], "left_anti").select("case_id", "kind", "id")


def unanswerable(cases: DataFrame, docs: DataFrame, gaps: dict[str, list[str]]) -> DataFrame:
    """(case_id, gap_id, term, doc_id): unanswerable rows of cases(case_id, answerable, gap_id) whose gap is not declared
    (term and document null), or of whose gap a document holds a term, whatever its case.

    Terms are a short declared list: the bodies are read once and nothing but the hits is joined.
    """
    own = cases.where("NOT answerable").select("case_id", "gap_id").distinct()
    found = [F.when(F.contains(F.lower("body"), F.lit(t.lower())), F.struct(F.lit(g).alias("gap_id"), F.lit(t).alias("term"))) for g, ts in gaps.items() for t in ts]
    hits = docs.select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("x")).select("x.gap_id", "x.term", "doc_id") if found else None
    none = own.where(~F.coalesce(F.col("gap_id").isin(list(gaps)), F.lit(False))).select("case_id", "gap_id", F.lit(None).cast("string").alias("term"), F.lit(None).cast("string").alias("doc_id"))
    return none if hits is None else none.unionByName(own.join(hits, "gap_id").select("case_id", "gap_id", "term", "doc_id"))


def superseded_values(old: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, side, doc_id, problem): rows of old(id, side, value, doc_id) whose document does not exist, or does not hold the
    value in plain form.  Both versions of a fact must be there."""
    bodies = docs.select("doc_id", F.coalesce("body", F.lit("")).alias("body"))
    problem = F.when(F.col("body").isNull(), "no document").when(~F.contains(T.plain("body"), T.plain("value")), "no value")
    return old.join(bodies, "doc_id", "left").select("id", "side", "doc_id", problem.alias("problem")).where("problem IS NOT NULL")


def facts_present(facts: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, problem): facts(id, value, aliases, value_components, authoritative_doc, restated_in) whose document
    does not exist (authority), or does not hold the value in any accepted form (presence, restatement)."""
    bodies = docs.select("doc_id", "body")
    has = T.contains_fact(F.col("body"), F.col("value"), F.col("aliases"), F.col("value_components"))
    cols = ["id", "value", "aliases", "value_components"]
    own = facts.select(*cols, F.col("authoritative_doc").alias("doc_id")).withColumn("as_", F.lit("presence"))
    more = facts.select(*cols, F.explode("restated_in").alias("doc_id")).withColumn("as_", F.lit("restatement"))
    both = own.unionByName(more).join(bodies.withColumn("there", F.lit(True)), "doc_id", "left")
    problem = F.when(F.col("there").isNull(), F.when(F.col("as_") == "presence", "authority").otherwise("restatement")).when(~F.coalesce(has, F.lit(False)), F.col("as_"))
    return both.select("id", "doc_id", problem.alias("problem")).where("problem IS NOT NULL")


def rival_authority(facts: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, doc_id): documents that restate a fact and claim to own it, though the ledger names another."""
    claimed = docs.select("doc_id", F.explode("authoritative_for").alias("id"))
    return facts.select("id", "authoritative_doc", F.explode("restated_in").alias("doc_id")).join(claimed, ["id", "doc_id"]).where("doc_id <> authoritative_doc").select("id", "doc_id")


def near_figures(shown: DataFrame, report: DataFrame, keys: list[str], tolerance: float = 5e-4) -> DataFrame:
    """Keys whose shown value differs from the reported one by more than *tolerance*, or has none."""
    both = shown.join(report.withColumnRenamed("value", "reported"), keys, "left")
    return both.where(F.col("reported").isNull() | (F.abs(F.col("value") - F.col("reported")) > tolerance))


#: Form of case ids and the categories of cases; fixed values.
CASE_ID = r"^[FMAUBTC]-\d{2}$"
CATEGORIES = ["factual", "multi_hop", "aggregation", "unanswerable", "ambiguous", "temporal", "citation_stress"]


def case_schema(cases: DataFrame) -> DataFrame:
    """(case_id, problem): cases(case_id, category, question, answerable, expected_behaviour, split,
    reference_answer, n_documents, n_spans, gap_id) that break a declared rule; one row per broken rule.
    A rule that meets a null is broken."""
    c = F.col
    rules = {
        "id": ~c("case_id").rlike(CASE_ID),
        "category": ~c("category").isin(CATEGORIES),
        "question": F.length(F.trim("question")) < 1,
        "expected_behaviour": ~c("expected_behaviour").isin("answer", "abstain", "clarify"),
        "split": ~c("split").isin("dev", "test"),
        "answerable: reference answer": c("answerable") & c("reference_answer").isNull(),
        "answerable: evidence": c("answerable") & ((c("n_documents") < 1) | (c("n_spans") < 1)),
        "unanswerable: gap": ~c("answerable") & c("gap_id").isNull(),
        "unanswerable: no reference answer": ~c("answerable") & c("reference_answer").isNotNull(),
        "unanswerable: abstain": ~c("answerable") & (c("expected_behaviour") != "abstain"),
        "multi_hop: two documents": (c("category") == "multi_hop") & (c("n_documents") < 2),
        "ambiguous: clarify": (c("category") == "ambiguous") & (c("expected_behaviour") != "clarify"),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]))
    return cases.select("case_id", F.explode(broken).alias("problem"))
