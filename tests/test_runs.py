import hashlib
import json

import pytest
import yaml
from pyspark.sql import functions as F

from spanwise import cli, config, report
from spanwise.errors import CacheMissError, ConfigError, CorpusError, DatasetError, HeldOutSplitError
from spanwise.operators import embedding as E
from spanwise.operators import generation as N
from spanwise.operators import validate as V
from spanwise.plans import runs
from spanwise.sources import cases as K
from spanwise.sources import corpus as D
from spanwise.sources import traces as TR
from spanwise.sources.cache import Cache, completion_key

FRONT = {"title": "Prices", "version": "1", "effective_date": "2026-01-01", "status": "active", "owner": "desk", "synthetic": True, "disclaimer": "made up"}
BODIES = {
    "prices": "# Prices\n\nA small lamp costs 47 coins per month on every plan that we sell today.\n\n## Extras\n\nEach extra bulb costs 12 coins and is billed at the end of the month.\n",
    "old-prices": "# Old prices\n\nA small lamp used to cost 39 coins per month before the first of March.\n",
    "shipping": "# Shipping\n\nParcels to the islands leave on Tuesday or Friday and arrive within five days.\n",
}
CASES = {
    "cases": [
        {"id": "F-01", "category": "factual", "question": "What does a small lamp cost per month?", "answerable": True, "reference_answer": "47", "expected_abstention_behaviour": "answer", "split": "dev", "expected_document_ids": ["prices"], "expected_evidence_spans": [{"doc_id": "prices", "quote": "A small lamp  costs 47 coins"}], "required_facts": [{"fact_id": "lamp", "matcher": {"kind": "numeric", "value": 47}}], "forbidden_or_unsupported_claims": ["39 coins as the price"]},
        {"id": "U-01", "category": "unanswerable", "question": "Who founded the company?", "answerable": False, "expected_abstention_behaviour": "abstain", "split": "dev", "gap_id": "founders"},
        {"id": "M-01", "category": "multi_hop", "question": "When do parcels leave and what does an extra bulb cost?", "answerable": True, "reference_answer": "Tuesday", "expected_abstention_behaviour": "answer", "split": "dev", "expected_document_ids": ["shipping", "prices"], "expected_evidence_spans": [{"doc_id": "shipping", "quote": "Parcels to the islands leave on Tuesday"}, {"doc_id": "prices", "quote": "Each extra bulb costs 12 coins"}], "required_facts": [{"fact_id": "day", "matcher": {"kind": "regex", "pattern": "tuesday|friday"}}, {"fact_id": "bulb", "matcher": {"kind": "numeric", "value": 12}}]},
        {"id": "T-01", "category": "temporal", "question": "What did a lamp cost before March?", "answerable": True, "reference_answer": "39", "expected_abstention_behaviour": "answer", "split": "test", "expected_document_ids": ["old-prices"], "expected_evidence_spans": [{"doc_id": "old-prices", "quote": "39 coins per month"}]},
    ]
}
ANSWERS = {"F-01": "A small lamp costs 47 coins per month [C1].", "U-01": "The documentation provided does not answer this question."}


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("world")
    (root / "corpus").mkdir()
    for name, body in BODIES.items():
        (root / "corpus" / f"{name}.md").write_bytes(f"---\n{yaml.safe_dump(FRONT | {'title': name, 'authoritative_for': [name]})}---\n{body}".encode())
    (root / "cases.yaml").write_text(yaml.safe_dump(CASES))
    (root / "base.yaml").write_text(yaml.safe_dump({"name": "base", "chunker": {"kind": "fixed_size", "params": {"chunk_size": 120, "chunk_overlap": 20}}, "embedder": {"kind": "tfidf_svd", "params": {"dimension": 8, "features": 512}}, "retrieval": {"top_k": 2}, "evaluation": {"judge_model": "x"}}))
    (root / "better.yaml").write_text(yaml.safe_dump({"extends": "base.yaml", "name": "better", "chunker": {"kind": "markdown_structure", "params": {"min_chars": 10}}, "retrieval": {"kind": "hybrid_rrf", "top_k": 4, "deduplicate": True}}))
    docs = D.load_corpus(spark, str(root / "corpus"))
    return root, docs, K.load_cases(spark, root / "cases.yaml", documents=docs)


def responses(spark, world, cfg, answers):
    """Stored answers of the prompts that a run of *cfg* makes."""
    _, docs, tables = world
    ranked = runs.retrieve(tables["cases"], runs.build_chunks(docs, cfg), cfg)
    packed = N.pack_context(ranked, ["case_id"])
    prompts = tables["cases"].join(packed, "case_id").select("case_id", N.render_prompt(cfg.generator.prompt_template, F.col("context_text"), F.col("question")).alias("p")).collect()
    rows = [(hashlib.sha256(r.p.encode()).hexdigest(), answers[r.case_id], 10, 5, 3.0, "scripted") for r in prompts if r.case_id in answers]
    return spark.createDataFrame(rows, N.RESPONSES)


def test_configuration(world, tmp_path):
    root = world[0]
    base, better = config.load_config(root / "base.yaml"), config.load_config(root / "better.yaml")
    assert better.retrieval.top_k == 4 and better.embedder == base.embedder and better.pipeline_hash != base.pipeline_hash
    same = config.parse_config({"name": "other", "description": "x"}), config.parse_config({"name": "another"})
    assert same[0].pipeline_hash == same[1].pipeline_hash and same[0].config_hash != same[1].config_hash
    for raw in ({"name": "x", "extra": 1}, {"name": "x", "retrieval": {"topk": 3}}, {}):
        with pytest.raises(ConfigError):
            config.parse_config(raw)
    (tmp_path / "deep.yaml").write_text("extends: mid.yaml\nname: d\n")
    (tmp_path / "mid.yaml").write_text("extends: x.yaml\nname: m\n")
    with pytest.raises(ConfigError, match="one level"):
        config.load_config(tmp_path / "deep.yaml")


def test_corpus(spark, world, tmp_path):
    _, docs, _ = world
    rows = {r.doc_id: r for r in docs.collect()}
    assert set(rows) == set(BODIES) and rows["prices"].body == BODIES["prices"] and rows["prices"].authoritative_for == ["prices"]
    assert V.front_matter(docs).count() == 0
    for name, content, problem in (("a", b"no front", "front matter"), ("b", b"\xef\xbb\xbf---\nx: 1\n---\n", "byte order")):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "x.md").write_bytes(content)
        with pytest.raises(CorpusError, match=problem):
            D.load_corpus(spark, str(folder))
    twice = tmp_path / "twice"
    twice.mkdir()
    for f in "xy":
        (twice / f"{f}.md").write_text("---\ndoc_id: same\n---\nbody\n")
    with pytest.raises(CorpusError, match="one id"):
        D.load_corpus(spark, str(twice))


def test_encoding_and_checksums(spark, tmp_path):
    (tmp_path / "files").mkdir()
    for name, content in (("ok", b"fine"), ("mark", b"\xef\xbb\xbfx"), ("bad", b"\xff\xfe\xfa"), ("twice", "cafÃ©".encode())):
        (tmp_path / "files" / name).write_bytes(content)
    found = {r.path.rsplit("/", 1)[1]: r.problem for r in D.check_encoding(spark, str(tmp_path / "files")).collect()}
    assert found == {"mark": "byte order mark", "bad": "not UTF-8", "twice": "double encoding"}
    good = hashlib.sha256(b"fine").hexdigest()
    (tmp_path / "sums.md").write_text(f"# sums\n{good}  ok\n{'0' * 64}  bad\n{good}  lost\nnot a line\n")
    problems = V.checksums(D.read_checksums(spark, str(tmp_path / "sums.md")), D.file_checksums(spark, str(tmp_path / "files")))
    assert {tuple(r) for r in problems.collect()} == {("bad", "CHANGED"), ("lost", "MISSING")}


def test_cases_and_the_held_out_split(spark, world, tmp_path):
    root, docs, tables = world
    spans = {(r.case_id, r.span_idx): (r.char_start, r.char_end) for r in tables["spans"].collect()}
    at = BODIES["prices"].index("A small")
    assert spans["F-01", 0] == (at, at + len("A small lamp costs 47 coins"))
    log = tmp_path / "log.jsonl"
    with pytest.raises(HeldOutSplitError):
        K.load_cases(spark, root / "cases.yaml", split="test", ledger=log)
    assert K.read_access_ledger(spark, log).count() == 0
    K.load_cases(spark, root / "cases.yaml", split="test", allow_test=True, reason="final", ledger=log)
    assert [(r.reason, r.n_cases) for r in K.read_access_ledger(spark, log).collect()] == [("final", 1)]
    assert K.load_cases(spark, root / "cases.yaml", split=None)["cases"].count() == 4
    bad = {"cases": [CASES["cases"][0] | {"expected_evidence_spans": [{"doc_id": "prices", "quote": "never said"}]}]}
    (tmp_path / "bad.yaml").write_text(yaml.safe_dump(bad))
    with pytest.raises(DatasetError, match="F-01"):
        K.load_cases(spark, tmp_path / "bad.yaml", documents=docs)
    with pytest.raises(DatasetError, match="no cases"):
        K.load_cases(spark, root / "cases.yaml", split="train")


@pytest.mark.parametrize("kind", ["dense", "bm25", "hybrid_rrf"])
def test_a_run_from_documents_to_metrics(spark, world, kind, tmp_path):
    root, docs, tables = world
    cfg = config.parse_config({"name": "t", "chunker": {"kind": "markdown_structure", "params": {"min_chars": 10}}, "embedder": {"kind": "tfidf_svd", "params": {"dimension": 8, "features": 512}}, "retrieval": {"kind": kind, "top_k": 3}})
    result = runs.run(spark, cfg, docs, tables, responses(spark, world, cfg, ANSWERS), dataset_id="d")
    traces = {r.case_id: r for r in result["traces"].collect()}
    assert traces["M-01"].errors and traces["M-01"].answer is None and traces["M-01"].metrics is None
    assert not traces["F-01"].errors and len(traces["F-01"].retrieved) == 3 and traces["F-01"].context_labels["C1"] == traces["F-01"].retrieved[0].chunk_id
    m = {r.case_id: r for r in result["metrics"].collect()}
    assert set(m) == {"F-01", "U-01"}
    assert (m["F-01"].required_fact_coverage, m["F-01"].abstention_correct, m["F-01"].forbidden_claims, m["F-01"].n_fabricated) == (1.0, True, 0, 0)
    assert (m["U-01"].recall_at_5, m["U-01"].required_fact_coverage, m["U-01"].abstention_observed) == (None, None, "abstain")
    assert m["F-01"].recall_at_5 == 1.0 and m["F-01"].claim_citation_coverage == 1.0
    folder = runs.write_run(result, cfg, tmp_path)
    back = TR.read_traces(spark, str(folder))
    assert back.count() == 3 and TR.retrieved_of(back).count() == 9
    assert json.loads((folder / "metrics.json").read_text())["error_rate"]["n"] == 3


def test_comparison_and_rescoring(spark, world, tmp_path):
    root, docs, tables = world
    every = ANSWERS | {"M-01": "Parcels leave on Tuesday [C1]. A bulb costs 12 coins [C9]."}
    folders = []
    for name in ("base", "better"):
        cfg = config.load_config(root / f"{name}.yaml")
        result = runs.run(spark, cfg, docs, tables, responses(spark, world, cfg, every), run_id=name)
        folders.append(str(runs.write_run(result, cfg, tmp_path)))
    b, i = (TR.read_traces(spark, f) for f in folders)
    c = report.compare(b, i, resamples=200)
    assert c["n_cases"] == 3 and c["counters"]["n_fabricated"]["improved"] == 1 and c["latency"]["baseline"]["p50_ms"] == 3.0
    files = report.write_comparison(c, tmp_path / "report")
    assert "| n_fabricated |" in files["comparison.md"].read_text() and b"\r" not in files["metrics.csv"].read_bytes()
    assert json.loads(files["comparison.json"].read_text())["n_cases"] == 3
    again = report.rescore(b, i, tables["spans"].withColumn("span_id", F.col("span_idx")), tables["cases"].select("case_id", F.explode("expected_document_ids").alias("doc_id")))
    assert {r["analysis"] for r in again} == {"configured", "common"}
    assert report.as_csv(again, ["analysis"]).splitlines()[0].startswith("analysis,metric")
    assert c["provenance"]["improved"]["pipeline_hash"] == config.load_config(root / "better.yaml").pipeline_hash
    assert b"\r" not in report.write_rescored(again, tmp_path / "again", "dev")["comparison.csv"].read_bytes()
    grid = spark.createDataFrame([("a", 4, 0.5), ("b", 8, None)], "kind string, top_k int, mrr double")
    assert report.write_ablation(grid, ["kind", "top_k"], tmp_path / "grid")["ablation.csv"].read_text() == "kind,top_k,mrr\na,4,0.5\nb,8,\n"
    assert b.select("environment").head()[0]["seed"] == "20260806"
    near = V.near_figures(grid.select("kind", F.col("mrr").alias("value")), spark.createDataFrame([("a", 0.5004)], "kind string, value double"), ["kind"])
    assert [r.kind for r in near.collect()] == ["b"]


def test_cache(spark, tmp_path):
    cache = Cache(spark, tmp_path, "llm")
    keys = [completion_key(provider="p", model="m", params={"b": 1, "a": 2}, prompt=p, template_sha="t") for p in "xy"]
    assert keys[0] == completion_key(provider="p", model="m", params={"a": 2, "b": 1}, prompt="x", template_sha="t") != keys[1]
    requests = spark.createDataFrame([(k,) for k in keys], "key string")
    assert cache.stats() == {"entries": 0, "bytes": 0} and cache.misses(requests).count() == 2
    cache.put(spark.createDataFrame([(keys[0], "one")], "key string, payload string"))
    assert {r.key: (r.payload, r.cache_hit) for r in cache.lookup(requests).collect()} == {keys[0]: ("one", True), keys[1]: (None, False)}
    with pytest.raises(CacheMissError):
        cache.require(requests)
    cache.put(spark.createDataFrame([(keys[1], "two")], "key string, payload string"))
    assert cache.require(requests).count() == 2 and cache.stats() == {"entries": 2, "bytes": 6}


def test_embedder(spark, tmp_path):
    texts = spark.createDataFrame([(t,) for t in ["red lamp price", "red lamp cost", "island parcel day", "Ísland parcel days", "", None]], "text string")
    model, again = (E.fit_tfidf_svd(texts, 3, n_features=256) for _ in range(2))
    assert model.fingerprint == again.fingerprint and model.dimension == 3
    rows = {r.text: r.vector for r in E.encode(texts, model).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(rows[a], rows[b], strict=True))
    assert dot("red lamp price", "red lamp cost") > 0.8 > dot("red lamp price", "island parcel day") + 0.4
    assert dot("red lamp price", "red lamp price") == pytest.approx(1, abs=1e-5) and rows[""] == [0, 0, 0]
    cache, asked = Cache(spark, tmp_path, "emb"), []

    def missing(df):
        asked.append(df.count())
        return E.encode(df, model)

    first = E.encode_cached(texts.where("text <> ''"), model.fingerprint, missing, cache)
    assert first.count() == 4
    assert E.encode_cached(texts.where("text <> ''"), model.fingerprint, missing, cache).count() == 4 and asked == [4, 0]


def test_ledger_checks(spark, world, tmp_path):
    _, docs, tables = world
    ledger = {"facts": [{"id": "lamp", "value": "47 coins", "authoritative_doc": "prices", "restated_in": ["shipping"]}, {"id": "gone", "value": "1", "authoritative_doc": "nowhere"}, {"id": "old-prices", "value": "39 coins", "authoritative_doc": "prices", "aliases": ["47"], "restated_in": ["old-prices"]}], "gaps": [{"id": "founders", "probe_terms": ["founder", "Friday"]}]}
    (tmp_path / "facts.yaml").write_text(yaml.safe_dump(ledger))
    t = D.load_ledger(spark, tmp_path / "facts.yaml")
    assert {tuple(r) for r in V.facts_present(t["facts"], docs).collect()} == {("lamp", "shipping", "restatement"), ("gone", "nowhere", "authority")}
    assert {tuple(r) for r in V.rival_authority(t["facts"], docs).collect()} == {("old-prices", "old-prices")}
    assert {tuple(r) for r in V.gap_probes(docs, {"founders": ["founder", "Friday"]}).collect()} == {("founders", "Friday", "shipping")}
    rows = [("F-01", "factual", "What?", True, "a", "answer", "dev", 1, 1, None), ("X1", "odd", "", False, "a", "answer", "train", 0, 0, None), ("M-02", "multi_hop", "What?", True, "a", "answer", "dev", 1, 1, None)]
    bad = V.case_schema(spark.createDataFrame(rows, "case_id string, category string, question string, answerable boolean, reference_answer string, expected_behaviour string, split string, n_documents int, n_spans int, gap_id string")).collect()
    assert {r.case_id for r in bad} == {"X1", "M-02"} and sum(r.case_id == "X1" for r in bad) == 7
    few = V.distribution(tables["cases"], {"factual": 2}, 3).collect()
    assert {(r.category, r.problem) for r in few} == {("factual", "too few")} | {(r.category, "one split") for r in tables["cases"].groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("split").alias("s")).where("n > 1 AND s < 2 AND category <> 'factual'").collect()}
    assert ("temporal", 0, 0, "too few") in {tuple(r) for r in V.distribution(tables["cases"], V.LEAST_CASES).collect()}


def test_planted_violations_are_found(spark, world, tmp_path):
    _, docs, _ = world
    old = [("price", "current", "47 **coins**", "prices"), ("price", "previous", "no such value", "prices"), ("gone", "current", "1", "nowhere")]
    got = V.superseded_values(spark.createDataFrame(old, "id string, side string, value string, doc_id string"), docs)
    assert {tuple(r) for r in got.collect()} >= {("price", "previous", "prices", "no value"), ("gone", "current", "nowhere", "no document")}
    cases = spark.createDataFrame([("U-01", False, "founders"), ("U-02", False, "nothing"), ("U-03", False, None), ("F-01", True, "founders"), ("U-01", False, "founders")], "case_id string, answerable boolean, gap_id string")
    hits = {tuple(r) for r in V.unanswerable(cases, docs, {"founders": ["friDAY", "unheard of"]}).collect()}
    assert hits == {("U-01", "founders", "friDAY", "shipping"), ("U-02", "nothing", None, None), ("U-03", None, None, None)}
    assert len(V.unanswerable(cases, docs, {}).collect()) == 3
    named = spark.createDataFrame([("c", "fact", "a"), ("c", "fact", "b"), ("c", "chain", "a"), ("c", "chain", None)], "case_id string, kind string, id string")
    declared = spark.createDataFrame([("fact", "a"), ("fact", "a")], "kind string, id string")
    assert {tuple(r) for r in V.undeclared(named, declared).collect()} == {("c", "fact", "b"), ("c", "chain", "a")}
    spans = spark.createDataFrame([("c", "prices", "no such words"), ("c", "nowhere", "x")], "case_id string, doc_id string, quote string")
    assert [r.doc_id for r in V.unresolved_quotes(spans, docs).collect()] == ["prices"]


def test_command_line(spark, world, tmp_path, capsys):
    root, _, _ = world
    assert cli.main(["run", "--config", "x", "--corpus", "x", "--dataset", "x", "--responses", "x", "--final"]) == 2
    assert cli.main(["ingest", "--config", str(root / "base.yaml"), "--corpus", str(root / "corpus"), "--manifest-out", str(tmp_path / "m")]) == 0
    assert cli.main(["validate", "--corpus", str(root / "corpus")]) == 0
    assert cli.main(["validate", "--corpus", str(root / "corpus"), "--dataset", str(root / "cases.yaml")]) == 1
    assert "distribution: 8" in capsys.readouterr().out
    assert cli.main(["ledger", "--ledger", str(tmp_path / "none")]) == 0
    cfg = config.load_config(root / "base.yaml")
    responses(spark, world, cfg, ANSWERS).write.json(str(tmp_path / "answers"))
    assert cli.main(["run", "--config", str(root / "base.yaml"), "--corpus", str(root / "corpus"), "--dataset", str(root / "cases.yaml"), "--responses", str(tmp_path / "answers"), "--out", str(tmp_path / "runs")]) == 0
    folder = capsys.readouterr().out.split()[-1]
    assert cli.main(["compare", folder, folder, "--out", str(tmp_path / "rep"), "--resamples", "50"]) == 0
