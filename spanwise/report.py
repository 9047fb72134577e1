"""Comparisons of two runs: computed as tables, rendered on the driver from a few rows."""

from __future__ import annotations

import csv
import io
import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .operators import stats as G

METRICS = ["recall_at_1", "recall_at_3", "recall_at_5", "recall_at_10", "mrr", "document_recall", "required_fact_coverage", "citation_validity", "citation_precision_doc", "claim_citation_coverage"]
COUNTERS = ["n_fabricated", "forbidden_claims"]
RESCORED = ["recall", "mrr", "precision", "document_recall"]


def flat(traces: DataFrame) -> DataFrame:
    """Error-free traces with their metrics as columns, one per case: the last written wins."""
    ok = traces.where("coalesce(size(errors), 0) <= 0")
    own = ok.select("run_id", "case_id", "split", "category", "latency_ms", "cache_hit", "top_k", "metrics.*")
    return own.withColumn("_at", F.monotonically_increasing_id()).groupBy("case_id").agg(F.max_by(F.struct(*[c for c in own.columns if c != "case_id"]), "_at").alias("r")).select("case_id", "r.*")


def compare(baseline: DataFrame, improved: DataFrame, resamples: int = G.RESAMPLES, seed: int = G.SEED) -> dict[str, Any]:
    """Two runs' traces, case by case over the cases free of errors in both: a dictionary of small results."""
    b, i = flat(baseline), flat(improved)
    shared = b.select("case_id").join(i.select("case_id"), "case_id")
    b, i = materialise(b.join(shared, "case_id")), materialise(i.join(shared, "case_id"))
    rows = {r["metric"]: r.asDict() for r in G.compare_exact(G.pair(b, i, [*METRICS, "abstention_correct"]), resamples=resamples, seed=seed).collect()}
    small = lambda x: round(x, 4) if isinstance(x, float) else x
    total = lambda df: df.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTERS]).head().asDict()
    before, after = total(b), total(i)
    seen = lambda df: {f"{r['abstention_expected']}->{r['abstention_observed']}": r["n"] for r in G.confusion(df, [], "abstention_expected", "abstention_observed").collect()}

    def latency(df: DataFrame) -> dict:
        one = df.withColumn("all", F.lit(1))
        row = G.order_statistics(one, ["all"], "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95}).head()
        mean, hit = df.agg(F.avg("latency_ms"), F.avg(F.col("cache_hit").cast("int"))).head()
        return {"p50_ms": row and row["p50_ms"], "p95_ms": row and row["p95_ms"], "mean_ms": mean, "cache_hit_rate": hit}

    cats = G.pair(b, i, ["recall_at_5", "required_fact_coverage"]).join(b.select("case_id", "category"), "case_id").groupBy("category", "metric").agg(F.count("*").alias("n"), F.avg("baseline").alias("baseline"), F.avg("improved").alias("improved"))
    first = b.select("split", "run_id").head()
    return {
        "split": first and first["split"],
        "baseline_run": first and first["run_id"],
        "improved_run": (r := i.select("run_id").head()) and r["run_id"],
        "n_cases": shared.count(),
        "metrics": [{k: small(v) for k, v in rows[m].items()} for m in METRICS if m in rows and rows[m]["n_paired"] >= 3],
        "counters": {c: {"baseline": before[c], "improved": after[c]} for c in COUNTERS},
        "abstention": {"accuracy": {k: small(v) for k, v in rows.get("abstention_correct", {}).items()}, "baseline_confusion": seen(b), "improved_confusion": seen(i)},
        "per_category": [{k: small(v) for k, v in r.asDict().items()} for r in cats.orderBy("category", "metric").collect()],
        "latency": {"baseline": latency(b), "improved": latency(i)},
        "provenance": {arm: provenance(t) for arm, t in (("baseline", baseline), ("improved", improved))},
        "resamples": resamples,
        "seed": seed,
    }


def provenance(traces: DataFrame) -> dict[str, Any]:
    """What the traces of a run say about how they were made."""
    names = ("pipeline_hash", "corpus_manifest_sha", "dataset_id", "generator_model", "template_sha")
    row = traces.select(*names).head()
    return row.asDict() if row else dict.fromkeys(names)


def _number(x: float | None, spec: str = ".3f") -> str:
    return "-" if x is None else format(x, spec)


def _table(head: list[str], rows: list[list]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(str(x) for x in r) + " |" for r in rows), ""]


def _write(folder: str | Path, texts: dict[str, str]) -> dict[str, Path]:
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in texts.items():
        (folder / name).write_bytes(text.encode("utf-8"))
    return {name: folder / name for name in texts}


def as_markdown(c: dict[str, Any]) -> str:
    table = _table
    ci = lambda m: f"[{_number(m['ci_low'], '+.3f')}, {_number(m['ci_high'], '+.3f')}]"
    out = [f"# {c['baseline_run']} against {c['improved_run']}, split {c['split']}, {c['n_cases']} cases", ""]
    out += [f"Paired bootstrap over cases: {c['resamples']} resamples, seed {c['seed']}, 95% intervals. An interval that holds zero is no measurable difference.", ""]
    out += ["## Metrics", "", *table(["metric", "n", "baseline", "improved", "delta", "interval", "verdict"], [[m["metric"], m["n_paired"], _number(m["baseline_mean"]), _number(m["improved_mean"]), _number(m["delta"], "+.3f"), ci(m), m["direction"]] for m in c["metrics"]])]
    out += ["## Counts", "", *table(["counter", "baseline", "improved", "change"], [[k, v["baseline"], v["improved"], f"{v['improved'] - v['baseline']:+d}"] for k, v in c["counters"].items()])]
    both = sorted({*c["abstention"]["baseline_confusion"], *c["abstention"]["improved_confusion"]})
    out += ["## Behaviour", "", *table(["expected->observed", "baseline", "improved"], [[k, c["abstention"]["baseline_confusion"].get(k, 0), c["abstention"]["improved_confusion"].get(k, 0)] for k in both])]
    out += ["## Categories", "", *table(["category", "metric", "n", "baseline", "improved"], [[r["category"], r["metric"], r["n"], _number(r["baseline"]), _number(r["improved"])] for r in c["per_category"]])]
    out += ["## Latency", "", *table(["arm", "p50 ms", "p95 ms", "mean ms", "cache hits"], [[arm, *(_number(v, ".1f" if k != "cache_hit_rate" else ".3f") for k, v in x.items())] for arm, x in c["latency"].items()])]
    return "\n".join(out)


COLUMNS = ["metric", "n_paired", "baseline_mean", "improved_mean", "delta", "ci_low", "ci_high", "ci_excludes_zero", "direction"]


def as_csv(rows: list[dict[str, Any]], first: list[str] | None = None) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow([*(first or []), *COLUMNS])
    w.writerows([r.get(c) for c in [*(first or []), *COLUMNS]] for r in rows)
    return out.getvalue()


def write_comparison(c: dict[str, Any], folder: str | Path) -> dict[str, Path]:
    """comparison.json, comparison.md and metrics.csv, with line feeds on every system."""
    return _write(folder, {"comparison.json": json.dumps(c, indent=2, sort_keys=True) + "\n", "comparison.md": as_markdown(c) + "\n", "metrics.csv": as_csv(c["metrics"])})


def rescore(baseline: DataFrame, improved: DataFrame, spans: DataFrame, expected: DataFrame, threshold: float = 0.5, seed: int = G.SEED) -> list[dict[str, Any]]:
    """Both arms scored again from their stored retrievals: each at its own budget (the smallest top_k of its
    error-free traces), and both at the smaller of the two.  One row per analysis and metric."""
    from .operators import metrics as A
    from .sources.traces import retrieved_of

    ok = [t.where("coalesce(size(errors), 0) <= 0") for t in (baseline, improved)]
    budget = [t.agg(F.min("top_k")).head()[0] for t in ok]

    def arm(t: DataFrame, k: int) -> DataFrame:
        got = retrieved_of(t).where(F.col("rank") <= k)
        cases = t.select("run_id", "case_id")
        m = A.retrieval_metrics(cases, spans, got, threshold, (k,)).withColumnsRenamed({f"recall_at_{k}": "recall", f"precision_at_{k}": "precision"})
        return m.join(A.document_recall(cases, expected, got), ["run_id", "case_id"])

    out = []
    for analysis, ks in (("configured", budget), ("common", [min(budget)] * 2)):
        pairs = G.pair(arm(ok[0], ks[0]), arm(ok[1], ks[1]), RESCORED)
        rows = {r["metric"]: r.asDict() for r in G.compare_exact(pairs, seed=seed).collect()}
        out += [{"analysis": analysis, **rows[m]} for m in RESCORED if m in rows]
    return out


def write_rescored(rows: list[dict[str, Any]], folder: str | Path, split: str) -> dict[str, Path]:
    """The rows of ``rescore`` as JSON, Markdown and CSV, with line feeds on every system."""
    head = ["analysis", "metric", "n", "baseline", "improved", "delta", "interval", "verdict"]
    cells = [[r["analysis"], r["metric"], r["n_paired"], _number(r["baseline_mean"]), _number(r["improved_mean"]), _number(r["delta"], "+.3f"), f"[{_number(r['ci_low'], '+.3f')}, {_number(r['ci_high'], '+.3f')}]", r["direction"]] for r in rows]
    md = "\n".join([f"# Stored retrievals scored again, split {split}", "", "Configured: each arm at its own budget. Common: both at the smaller one.", "", *_table(head, cells)])
    return _write(folder, {"comparison.json": json.dumps(rows, indent=2, sort_keys=True) + "\n", "comparison.md": md + "\n", "comparison.csv": as_csv(rows, ["analysis"])})


def write_ablation(grid: DataFrame, variant: list[str], folder: str | Path) -> dict[str, Path]:
    """A table of variants (a handful of rows) as JSON, Markdown and CSV."""
    rows = [r.asDict() for r in grid.orderBy(*variant).collect()]
    head = grid.columns
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(head)
    w.writerows([r[c] for c in head] for r in rows)
    cells = [[_number(r[c], ".4f") if isinstance(r[c], float) or r[c] is None else r[c] for c in head] for r in rows]
    md = "\n".join(["# Variants", "", *_table(head, cells)])
    return _write(folder, {"ablation.json": json.dumps(rows, indent=2, sort_keys=True, default=str) + "\n", "ablation.md": md + "\n", "ablation.csv": out.getvalue()})
