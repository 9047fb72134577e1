import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.functions import text as T
from spanwise.operators import retrieval as R
from spanwise.plans import evaluation as E
from spanwise.plans import evaluation_sql

STOP = set(T.STOPWORDS)


def tokens(text):
    import re

    return [t for t in re.findall(T.TOKEN, (text or "").lower()) if t not in STOP]


def brute_bm25(queries, docs, k):
    toks = {d: tokens(t) for d, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(t for ts in toks.values() for t in set(ts))
    out = {}
    for q, text in queries.items():
        scores = {}
        for d, ts in toks.items():
            tf = Counter(ts)
            scores[d] = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ts) / max(avg, 1e-9))) for t in tokens(text) if t in tf)
        out[q] = [(d, round(s, 6)) for d, s in sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]]
    return out


def test_bm25_ranks_every_item(spark):
    rnd = random.Random(3)
    words = ["fee", "plan", "card", "2.9%", "the", "limit", "payout"]
    docs = {f"d{i:02d}": " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12))) for i in range(25)} | {"d90": "", "d91": None}
    queries = {"q1": "fee fee limit", "q2": "the of", "q3": "unknown word", "q4": "", "q5": "2.9% payout"}
    got = R.bm25_top_k(spark.createDataFrame([(q, t, 0) for q, t in queries.items()], "query_id string, text string, score int"), spark.createDataFrame(list(docs.items()), "item_id string, text string"), 6).collect()
    mine = {q: [(r.item_id, round(r.score, 6)) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] for q in queries}
    assert mine == brute_bm25(queries, docs, 6)


@pytest.mark.parametrize("limit", [200_000, 40])
def test_bm25_equals_brute_force_with_one_block_or_many(spark, monkeypatch, limit):
    monkeypatch.setattr(R, "QUERY_BLOCK_TERMS", limit)
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(30)] + ["the"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 15))) for _ in range(60)]
    docs = {f"d{i:03d}": texts[i % 60] for i in rnd.sample(range(150), 150)}
    queries = {f"q{i:02d}": " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6))) for i in range(30)}
    got = R.bm25_top_k(spark.createDataFrame(list(queries.items()), "query_id string, text string"), spark.createDataFrame(list(docs.items()), "item_id string, text string").repartition(3), 4).collect()
    mine = {q: [(r.item_id, round(r.score, 6)) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] for q in queries}
    assert mine == brute_bm25(queries, docs, 4)


def shuffled(spark, make):
    """Records that the stages of *make* wrote for a shuffle."""
    sc = spark.sparkContext
    store, no = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, no, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    make()
    return total() - before


def test_bm25_shuffles_no_row_per_query_and_item(spark):
    rnd = random.Random(1)
    words = ["fee", "plan", "card", "limit", "payout", "rate"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    queries = spark.createDataFrame([(f"q{i}", text(4)) for i in range(50)], "query_id string, text string")
    docs = spark.createDataFrame([(f"d{i}", text(8)) for i in range(800)], "item_id string, text string")
    assert shuffled(spark, lambda: R.bm25_top_k(queries, docs, 3).collect()) < 50 * 800 / 10


@pytest.mark.parametrize("limit", [200_000, 60])
def test_bm25_shuffles_no_more_rows_for_more_tasks(spark, monkeypatch, limit):
    monkeypatch.setattr(R, "QUERY_BLOCK_TERMS", limit)
    rnd = random.Random(4)
    words = ["fee", "plan", "card", "limit", "payout", "rate"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    queries, docs = {f"q{i:02d}": text(4) for i in range(50)}, {f"d{i:04d}": text(8) for i in range(1200)}
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.enabled": "false", "spark.sql.files.maxPartitionBytes": "1k"}
    old = {c: spark.conf.get(c, None) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        got = []
        q, d = spark.createDataFrame(list(queries.items()), "query_id string, text string"), spark.createDataFrame(list(docs.items()), "item_id string, text string")
        assert shuffled(spark, lambda: got.extend(R.bm25_top_k(q, d, 10).collect())) < 10_000  # 20,000 with a task for each of 40 files
    finally:
        for c, v in old.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    mine = {q: [(r.item_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] for q in queries}
    assert mine == {q: [(i, pytest.approx(x, abs=1e-6)) for i, x in own] for q, own in brute_bm25(queries, docs, 10).items()}


def test_scorecard_equals_its_sql_and_shuffles_no_row_per_query_and_chunk(spark, tmp_path):
    rnd = random.Random(2)
    words = ["fee", "plan", "card", "limit", "payout", "rate", "2.9%"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    at = "timestamp '2025-01-01'"
    chunks = [(f"d{i % 20}#{i}", f"d{i % 20}", text(8), i, i + 40) for i in range(800)]
    spark.createDataFrame(chunks, "chunk_id string, doc_id string, text string, char_start int, char_end int").selectExpr("*", "array('h') AS heading_path", f"{at} AS indexed_at").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(f"C-{i * 100:08d}", text(4)) for i in range(50)], "case_id string, query string").write.parquet(f"{tmp_path}/traces.parquet")
    spans = [(i, f"C-{i % 50 * 100:08d}", f"d{i % 20}", "q", 10 * i, 10 * i + 30) for i in range(75)]
    spark.createDataFrame(spans, "span_row_id bigint, case_id string, doc_id string, quote string, char_start int, char_end int").selectExpr("*", f"{at} AS authored_at").write.parquet(f"{tmp_path}/evidence_spans.parquet")
    rows = []
    assert shuffled(spark, lambda: rows.extend(E.retrieval_scorecard(spark, str(tmp_path)).collect())) < 50 * 800 / 4
    con = duckdb.connect()
    for t in ("chunks", "traces", "evidence_spans"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    cur = con.execute(evaluation_sql.ORACLES["retrieval_scorecard"])
    cols = [c[0] for c in cur.description]
    want = {r["case_id"]: r for r in (dict(zip(cols, x, strict=True)) for x in cur.fetchall())}
    assert len(rows) == len(want) == 50
    for r in rows:
        assert r.asDict() == {c: pytest.approx(v, abs=1e-6) if isinstance(v, float) else v for c, v in want[r.case_id].items()}


@pytest.mark.parametrize("limit", [32 * 2**20, 200])
def test_dense_search_is_exact_with_one_block_or_many(spark, monkeypatch, limit):
    monkeypatch.setattr(R, "QUERY_BLOCK_BYTES", limit)
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (40, 4)).astype(float)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [1.0])], "item_id int, vector array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:9])], "query_id int, vector array<double>")
    got = R.dense_top_k(queries, items.repartition(3), 5, 4).collect()
    for q in range(9):
        s = x @ x[q]
        want = sorted(range(40), key=lambda i: (-s[i], i))[:5]
        assert [r.item_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert R.dense_top_k(queries.limit(0), items, 5, 4).count() == 0


def test_rrf(spark):
    rows = spark.createDataFrame([("c", "a", 1), ("c", "b", 2), ("c", "b", 1), ("c", "a", 2), ("c", "x", None)], "case_id string, chunk_id string, rank int")
    got = R.rrf(rows, 5, ["case_id"]).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 9)) for r in got] == [("a", round(1 / 61 + 1 / 62, 9)), ("b", round(1 / 61 + 1 / 62, 9))]


def greedy(items, most):
    kept = []
    for rank, cid, text in sorted(items):
        ts = set(tokens(text))
        if ts and not any(len(ts & o) >= most * min(len(ts), len(o)) for _, _, o in kept):
            kept.append((rank, cid, ts))
    return [(cid, i + 1, rank) for i, (rank, cid, _) in enumerate(kept)]


def test_drop_repeats_is_greedy(spark):
    rnd = random.Random(9)
    items = [(c, f"k{i}", i + 1, " ".join(rnd.choice("abcdefgh") * 2 for _ in range(rnd.randint(0, 6)))) for c in ("c1", "c2", "c3") for i in range(12)] + [("c3", "kn", 13, None)]
    got = R.drop_repeats(spark.createDataFrame(items, "case_id string, chunk_id string, rank int, text string"), ["case_id"], 0.8).collect()
    for c in ("c1", "c2", "c3"):
        assert sorted(((r.chunk_id, r.rank, r.rank_before) for r in got if r.case_id == c), key=lambda x: x[1]) == greedy([(r, k, t) for cc, k, r, t in items if cc == c], 0.8)


def test_unit_length(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(R.l2_normalise(F.col("v"))).collect()] == [pytest.approx([0.6, 0.8]), [0.0, 0.0], None]
