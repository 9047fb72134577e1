"""Problem 1: cases of the dev and test splits that repeat a train case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import materialise, table
from . import overlap
from .words import words_sql


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """(case_id, split) of every case: the non-null values of its trace rows."""
    split = F.lower(F.regexp_replace("split", r"\s+", "")).alias("split")
    return table(spark, d, "traces").where("case_id IS NOT NULL AND split IS NOT NULL").select("case_id", split).where("split IN ('train', 'dev', 'test')").distinct()


def _overlaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    side = F.when(F.col("split") == "train", "train").otherwise("eval").alias("side")
    sides = _cases(spark, d).select(F.col("case_id").alias("owner"), side)
    text = lambda name, column: table(spark, d, name).select(F.col("case_id").alias("owner"), F.lit(column).alias("field"), F.col(column).alias("text"))
    return overlap.overlaps(text("traces", "query").unionByName(text("evidence_spans", "quote")), sides)


def _pairs(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(eval_case, train_case, field), each once."""
    ev = classes.where("side = 'eval'").select("field", F.col("cls").alias("eval_cls"), F.col("owner").alias("eval_case"))
    tr = classes.where("side = 'train'").select(F.col("cls").alias("train_cls"), F.col("owner").alias("train_case"))
    return links.select("eval_cls", "train_cls").join(ev, "eval_cls").join(tr, "train_cls").select("eval_case", "train_case", "field").where("eval_case <> train_case").distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(*_overlaps(spark, d))
    return pairs.select(F.least("eval_case", "train_case").alias("case_id_a"), F.greatest("eval_case", "train_case").alias("case_id_b"), "field").distinct()


def _per_case(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(case_id, field, n_pairs, coverage) of every evaluation case and field: the train cases that it repeats, and
    the greatest share of one of its texts that a training text covers.

    Cases with the same texts are counted together: as many cases may repeat as many, no pair of cases is made.
    """
    own = classes.groupBy("side", "owner", "field").agg(F.md5(F.array_join(F.array_sort(F.collect_set(F.hex("cls"))), "")).alias("texts"))
    own = materialise(own)
    of = lambda side, name: own.where(F.col("side") == side).select("owner", "field", F.col("texts").alias(name))
    ev, tr = of("eval", "ev"), of("train", "tr")
    sets = materialise(classes.join(own, ["side", "owner", "field"]).select("side", "field", "texts", "cls").distinct())
    side = lambda name, s, c: sets.where(F.col("side") == name).select("field", F.col("texts").alias(s), F.col("cls").alias(c))
    met = links.join(side("eval", "ev", "eval_cls"), "eval_cls").select("field", "ev", "train_cls", "coverage")
    linked = materialise(met.join(side("train", "tr", "train_cls").drop("field"), "train_cls").groupBy("field", "ev", "tr").agg(F.max("coverage").alias("coverage")))
    size = tr.groupBy("field", "tr").agg(F.count("*").alias("n"))
    sums = linked.join(size, ["field", "tr"]).groupBy("field", "ev").agg(F.sum("n").alias("n"), F.max("coverage").alias("coverage"))
    # a case of both sides is no pair with itself
    self_ = ev.join(tr, ["owner", "field"]).join(linked, ["field", "ev", "tr"]).select("owner", "field", F.lit(1).alias("own"))
    out = ev.join(sums, ["field", "ev"], "left").join(self_, ["owner", "field"], "left")
    return out.select(F.col("owner").alias("case_id"), "field", (F.coalesce("n", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("n_pairs"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation case and field: the train cases that it repeats and the share of its text that a training text covers."""
    return _per_case(*_overlaps(spark, d)).withColumn("coverage", F.round("coverage", 6))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per split and source of the evaluation case: its cases, those that repeat a train case by field, the pairs, and
    the mean share of a case's text (the most covered one) that a training text covers."""
    cases = _cases(spark, d).where("split <> 'train'")
    source = table(spark, d, "traces").where("dataset_id IS NOT NULL").select("case_id", "dataset_id").distinct()
    field = lambda f, c, agg: agg(F.when(F.col("field") == f, F.col(c)))
    per_case = _per_case(*_overlaps(spark, d)).groupBy("case_id").agg(field("query", "n_pairs", F.max).alias("n_query"), field("quote", "n_pairs", F.max).alias("n_quote"), F.max("coverage").alias("covered"))
    some = lambda c: F.count(F.when(F.col(c) > 0, 1))
    sums = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return (
        cases.join(source, "case_id", "left")
        .join(per_case, "case_id", "left")
        .groupBy("split", "dataset_id")
        .agg(F.count("*").alias("n_cases"), some("n_query").alias("n_cases_by_query"), some("n_quote").alias("n_cases_by_quote"), sums("n_query").alias("n_query_pairs"), sums("n_quote").alias("n_quote_pairs"), F.round(F.avg(F.coalesce("covered", F.lit(0.0))), 6).alias("mean_covered"))
    )


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p1_coverage": p1_coverage}

_SETS = f"""
splits AS (SELECT DISTINCT case_id, lower(regexp_replace(split, '\\s+', '', 'g')) AS split FROM traces WHERE case_id IS NOT NULL AND split IS NOT NULL),
texts AS (SELECT DISTINCT case_id, 'query' AS field, list_sort(list_distinct({words_sql("query")})) AS ws FROM traces WHERE query IS NOT NULL
  UNION SELECT DISTINCT case_id, 'quote', list_sort(list_distinct({words_sql("quote")})) FROM evidence_spans WHERE quote IS NOT NULL),
sided AS (SELECT t.*, s.split = 'train' AS train FROM texts t JOIN splits s USING (case_id) WHERE len(ws) > 0 AND s.split IN ('train', 'dev', 'test')),
once AS (SELECT field, ws, list_transform(range(0, len(ws) + 1), lambda i: coalesce(ws[i], '^') || ' ' || coalesce(ws[i + 1], '$')) AS ps, row_number() OVER (ORDER BY field, ws) AS id
  FROM (SELECT DISTINCT field, ws FROM sided)),
each AS (SELECT id, field, unnest(ws) AS w, len(ws) AS n FROM once),
alike AS (SELECT a.id AS ia, b.id AS ib, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS met FROM each a JOIN each b ON a.field = b.field AND a.w = b.w GROUP BY a.id, b.id),
owned AS (SELECT s.case_id, s.field, s.train, o.id, o.ps, len(o.ws) AS n FROM sided s JOIN once o ON o.field = s.field AND o.ws = s.ws),
pairs AS (SELECT e.case_id AS e, t.case_id AS t, e.field, max(len(list_filter(range(1, e.n + 1), lambda i: list_contains(t.ps, e.ps[i]) OR list_contains(t.ps, e.ps[i + 1]))) / e.n) AS covered
  FROM owned e JOIN alike x ON x.ia = e.id JOIN owned t ON t.id = x.ib WHERE NOT e.train AND t.train AND 4 * met >= 3 * (na + nb - met) AND e.case_id <> t.case_id GROUP BY ALL),
per_case AS (SELECT o.case_id, o.field, coalesce(any_value(p.n), 0) AS n_pairs, round(coalesce(any_value(p.covered), 0), 6) AS coverage FROM (SELECT DISTINCT case_id, field FROM owned WHERE NOT train) o
  LEFT JOIN (SELECT e AS case_id, field, count(*) AS n, max(covered) AS covered FROM pairs GROUP BY ALL) p USING (case_id, field) GROUP BY ALL)"""

ORACLES = {
    "p1_found": f"WITH {_SETS}\nSELECT DISTINCT least(e, t) AS case_id_a, greatest(e, t) AS case_id_b, field FROM pairs",
    "p1_coverage": f"WITH {_SETS}\nSELECT * FROM per_case",
    "p1_counts": f"""WITH {_SETS},
wide AS (SELECT case_id, max(n_pairs) FILTER (field = 'query') AS q, max(n_pairs) FILTER (field = 'quote') AS z, max(coverage) AS c FROM per_case GROUP BY case_id),
cases AS (SELECT s.case_id, s.split, d.dataset_id FROM splits s LEFT JOIN (SELECT DISTINCT case_id, dataset_id FROM traces WHERE dataset_id IS NOT NULL) d USING (case_id) WHERE s.split IN ('dev', 'test'))
SELECT split, dataset_id, count(*) AS n_cases, count(*) FILTER (q > 0) AS n_cases_by_query, count(*) FILTER (z > 0) AS n_cases_by_quote,
  coalesce(sum(q), 0)::BIGINT AS n_query_pairs, coalesce(sum(z), 0)::BIGINT AS n_quote_pairs, round(avg(coalesce(c, 0)), 6) AS mean_covered FROM cases LEFT JOIN wide USING (case_id) GROUP BY ALL""",
}
