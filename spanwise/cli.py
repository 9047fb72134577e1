"""Command line: ingest, run, compare, validate, ledger."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def _spark():
    from .common import session

    return session()


def ingest(args: argparse.Namespace) -> int:
    from .config import load_config
    from .plans.runs import build_chunks
    from .sources.corpus import load_corpus, manifest

    spark, config = _spark(), load_config(args.config)
    docs = load_corpus(spark, args.corpus)
    print(f"configuration {config.name} ({config.pipeline_hash}); documents {docs.count()}; chunks {build_chunks(docs, config).count()}")
    if args.manifest_out:
        manifest(docs).coalesce(1).write.mode("overwrite").json(args.manifest_out)
    return 0


def run(args: argparse.Namespace) -> int:
    from .config import load_config
    from .operators.generation import RESPONSES
    from .plans import runs
    from .sources.cases import load_cases
    from .sources.corpus import load_corpus

    if args.final and not args.reason:
        print("--final needs --reason: each access to the held-out split is logged with one", file=sys.stderr)
        return 2
    spark, config = _spark(), load_config(args.config)
    docs = load_corpus(spark, args.corpus)
    tables = load_cases(spark, args.dataset, split="test" if args.final else "dev", allow_test=args.final, reason=args.reason or "unspecified", documents=docs, ledger=args.ledger)
    result = runs.run(spark, config, docs, tables, spark.read.schema(RESPONSES).json(args.responses), dataset_id=Path(args.dataset).stem, limit=args.limit)
    print(runs.write_run(result, config, args.out))
    return 0


def compare(args: argparse.Namespace) -> int:
    from .report import compare as compare_runs
    from .report import write_comparison
    from .sources.traces import read_traces

    spark = _spark()
    c = compare_runs(read_traces(spark, args.baseline), read_traces(spark, args.improved), args.resamples, args.seed)
    for m in c["metrics"]:
        print(f"{m['metric']:26s} {m['baseline_mean']:.3f} -> {m['improved_mean']:.3f}  {m['delta']:+.3f} [{m['ci_low']:+.3f}, {m['ci_high']:+.3f}]  {m['direction']}")
    for path in write_comparison(c, args.out).values():
        print(path)
    return 0


def _checks(spark, args: argparse.Namespace) -> list:
    """(name, rows that break the check) of everything that the arguments give."""
    from pyspark.sql import functions as F

    from .operators import validate as V
    from .sources.cases import load_cases
    from .sources.corpus import load_corpus, load_ledger

    docs = load_corpus(spark, args.corpus)
    out = [("front matter", V.front_matter(docs))]
    gaps: dict[str, list[str]] = {}
    if args.facts:
        known = load_ledger(spark, args.facts)
        gaps = {r["id"]: r["probe_terms"] for r in known["gaps"].collect()}
        out += [("fact", V.facts_present(known["facts"], docs)), ("authority", V.rival_authority(known["facts"], docs)), ("superseded", V.superseded_values(known["superseded"], docs)), ("gap", V.gap_probes(docs, gaps))]
    if args.dataset:
        tables = load_cases(spark, args.dataset, split=None)
        cases, spans = tables["cases"], tables["spans"]
        named = cases.select("case_id", "answerable", F.explode("expected_document_ids").alias("doc_id"))
        per_case = spans.groupBy("case_id").agg(F.count("*").alias("n_spans"))
        formed = cases.join(per_case, "case_id", "left").select("*", F.size("expected_document_ids").alias("n_documents")).fillna({"n_spans": 0})
        out += [
            ("form", V.case_schema(formed)),
            ("repeated case", V.duplicates(cases, ["case_id"])),
            ("unknown document", V.missing_keys(named.select("case_id", "doc_id"), docs, "doc_id")),
            ("quote without a place", V.unresolved_quotes(spans, docs)),
            ("no span in document", V.unjustified_documents(named.where("answerable").select("case_id", "doc_id"), spans)),
            ("distribution", V.distribution(cases, V.LEAST_CASES)),
        ]
        if args.facts:
            ids = lambda kind, df, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("id"))
            declared = ids("fact", known["facts"], "id").unionByName(ids("fact", known["superseded"], "id")).unionByName(ids("chain", known["chains"], "id"))
            used = tables["facts"].select("case_id", F.lit("fact").alias("kind"), F.col("fact_id").alias("id")).unionByName(cases.select("case_id", F.lit("chain").alias("kind"), F.col("source_chain_id").alias("id")))
            out += [("not in the ledger", V.undeclared(used, declared)), ("unanswerable", V.unanswerable(cases, docs, gaps))]
    return out


def validate(args: argparse.Namespace) -> int:
    """Prints every broken rule, and their number by check."""
    from .sources.corpus import check_encoding

    spark = _spark()
    checks = [("encoding", check_encoding(spark, args.corpus))]
    if checks[0][1].isEmpty():
        checks = _checks(spark, args)
    total = 0
    for name, df in checks:
        n = 0
        for row in df.toLocalIterator():
            n += 1
            print(f"{name}: {json.dumps(row.asDict(), ensure_ascii=False)}", file=sys.stderr)
        print(f"{name}: {n}")
        total += n
    return 1 if total else 0


def ledger(args: argparse.Namespace) -> int:
    from .sources.cases import read_access_ledger

    rows = read_access_ledger(_spark(), args.ledger).orderBy("ts").collect()
    print(f"the held-out split was read {len(rows)} time(s)")
    for r in rows:
        print(f"  {r['ts']}  {r['n_cases']} cases  {r['reason']}")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanwise")
    sub = p.add_subparsers(dest="command", required=True)

    def command(f, *arguments: tuple[str, dict]) -> None:
        s = sub.add_parser(f.__name__)
        for name, options in arguments:
            s.add_argument(name, **options)
        s.set_defaults(call=f)

    need, config, corpus = {"required": True}, ("--config", {"required": True}), ("--corpus", {"required": True})
    log = ("--ledger", {"default": "runs/test_access.jsonl"})
    command(ingest, config, corpus, ("--manifest-out", {}))
    command(run, config, corpus, ("--dataset", need), ("--responses", need), ("--out", {"default": "runs"}), ("--final", {"action": "store_true"}), ("--reason", {}), ("--limit", {"type": int}), log)
    command(compare, ("baseline", {}), ("improved", {}), ("--out", {"default": "reports"}), ("--resamples", {"type": int, "default": 10_000}), ("--seed", {"type": int, "default": 20260806}))
    command(validate, corpus, ("--dataset", {}), ("--facts", {}))
    command(ledger, log)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.call(args)


if __name__ == "__main__":
    sys.exit(main())
