import random

import numpy as np
import pytest

from spanwise.llm import fusion as U

SCHEMA = "run string, case string, pos int, item string, a double, b double, c double, at timestamp_ntz, fused_score string"
DIRECTIONS = {"a": 1, "b": 1, "c": -1}


def rows(seed=1, runs=3):
    import datetime as dt

    rnd = random.Random(seed)
    out = []
    for r in range(runs):
        scale = 10.0**r
        for c in range(30):
            for p in range(6):
                q = rnd.random()
                a, b = scale * (q + rnd.gauss(0, 0.1)), 1e6 * scale * (q + rnd.gauss(0, 0.1)) ** 3
                out.append((f"r{r}", f"c{c}", p + 1, f"i{p}", None if rnd.random() < 0.1 else a, float("nan") if rnd.random() < 0.05 else b, -q + rnd.gauss(0, 0.2), dt.datetime(2026, 1, 1), "x"))
    return out


def place(e, x):
    lo, hi = np.searchsorted(e, x, "left"), np.searchsorted(e, x, "right")
    return ((lo + hi - 1) / 2 if hi > lo else lo - 1 + (x - e[lo - 1]) / (e[lo] - e[lo - 1])) / (U.EDGES - 1)


def brute(data):
    last = {}
    for r, c, p, i, a, b, cc, _, _ in data:
        last[r, c, p] = (i, a, b, None if cc is None else -cc)
    ok = lambda v: v is not None and np.isfinite(v)
    out, ranks = {}, []
    edges = {}
    for r in {k[0] for k in last}:
        for s in range(1, 4):
            v = np.sort([x[s] for k, x in last.items() if k[0] == r and ok(x[s])])
            n = len(v)
            edges[r, s] = np.array([v[0], *(v[max(0, int(np.ceil(q / (U.EDGES - 1) * n)) - 1)] for q in range(1, U.EDGES - 1)), v[-1]])
    for k, x in last.items():
        ranks.append([place(edges[k[0], s], x[s]) if ok(x[s]) else np.nan for s in range(1, 4)])
    m = np.array(ranks)
    corr = np.eye(3)
    for i in range(3):
        for j in range(3):
            both = ~np.isnan(m[:, i]) & ~np.isnan(m[:, j])
            corr[i, j] = np.corrcoef(m[both, i], m[both, j])[0, 1]
    w = U.loadings(corr)
    for (k, x), row in zip(last.items(), m, strict=True):
        has = ~np.isnan(row)
        out[k] = round(float((row[has] * w[has]).sum() / w[has].sum()), 6) if has.any() else None
    return out


@pytest.mark.parametrize("most", [4096, 1])
def test_scores_match_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(U, "MAX_BROADCAST_RUNS", most)
    data = rows()
    got = U.fuse(spark.createDataFrame(data + data[:40], SCHEMA), "run", ["run", "case"], "pos", "item", DIRECTIONS, "at").collect()
    assert {(r.run, r.case, r.pos): round(r.fused_score, 6) for r in got} == pytest.approx(brute(data), abs=3e-6)
    for r in {x.run for x in got}:
        one = sorted((x for x in got if x.run == r and x.case == "c0"), key=lambda x: x.fused_rank)
        assert [x.fused_rank for x in one] == [1, 2, 3, 4, 5, 6] and all(x.fused_score >= y.fused_score for x, y in zip(one, one[1:], strict=False))


def test_exact_ranks_match_brute_force(spark):
    data = rows(2) + [(None, "c0", 1, "i1", 0.5, 0.5, -0.5, None, "x"), (None, "c0", 2, "i2", 0.7, 0.5, -0.5, None, "x")]
    df = U.clean(spark.createDataFrame(data, SCHEMA), ["run", "case"], "pos", "item", ["a", "b", "c"], "at")
    edges = U.rank_edges(df, "run", ["a", "b", "c"])
    got = U.exact_ranks(df, edges, 4, "run", ["run", "case"], "pos", "item", ["a", "b", "c"]).collect()
    near = {(r.run, r.case, r.pos): r for r in U.rank_transform(df, edges, 4, "run", ["run", "case"], ["a", "b", "c"]).collect()}
    kept = [(r.run, r.case, r.pos, {s: r[s] for s in "abc"}) for r in df.collect()]
    assert len(got) == len(kept)
    for r in got:
        own = next(x for run, case, pos, x in kept if (run, case, pos) == (r.run, r.case, r.pos))
        for s in "abc":
            if own[s] is None:
                assert r[f"_r_{s}"] is None
                continue
            all_ = np.array([x[s] for run, _, _, x in kept if run == r.run and x[s] is not None])
            assert r[f"_r_{s}"] == pytest.approx(((all_ < own[s]).sum() + (all_ == own[s]).sum() / 2) / len(all_))
            assert r.run is None or abs(near[r.run, r.case, r.pos][f"_r_{s}"] - r[f"_r_{s}"]) < 0.01
    fused = U.fuse(spark.createDataFrame(rows(), SCHEMA), "run", ["run", "case"], "pos", "item", DIRECTIONS, "at", exact=True)
    assert fused.count() == len(rows())


def test_different_scores_never_tie(spark):
    import datetime as dt

    t = dt.datetime(2026, 1, 1)
    data = [("r", f"c{i // 5}", i % 5, f"i{4 - i % 5}", i / 7, i / 3, i / 2, t, "") for i in range(2000)]
    got = U.fuse(spark.createDataFrame(data, SCHEMA), "run", ["run", "case"], "pos", "item", {"a": 1, "b": 1, "c": 1}, "at").collect()
    assert all(r.fused_rank == 5 - r.pos for r in got)
    few = [(None, "c", None, "a", 1.0, None, None, t, ""), (None, "c", None, "b", 2.0, None, None, t, ""), (None, "c", None, "b", 2.0, None, None, t, "")]
    got = U.fuse(spark.createDataFrame(few, SCHEMA), "run", ["run", "case"], "pos", "item", DIRECTIONS, "at").collect()
    assert sorted((r.item, r.fused_rank) for r in got) == [("a", 2), ("b", 1)] and all(r.fused_score is not None for r in got)


def test_no_score_decides_by_its_range(spark):
    data = rows()
    big = [(*r[:4], r[4], None if r[5] is None else r[5] * 1e9, *r[6:]) for r in data]
    run = lambda d: {(r.run, r.case, r.item): r.fused_rank for r in U.fuse(spark.createDataFrame(d, SCHEMA), "run", ["run", "case"], "pos", "item", DIRECTIONS, "at").collect()}
    assert run(data) == run(big)


def test_missing_ties_and_empty(spark):
    import datetime as dt

    t = dt.datetime(2026, 1, 1)
    odd = [("r", "c", 1, "x", None, None, None, t, ""), ("r", "c", 2, "b", 1.0, 1.0, -1.0, t, ""), ("r", "c", 3, "a", 1.0, 1.0, -1.0, t, ""), ("r", "c", 4, None, float("inf"), 2.0, -2.0, None, ""), (None, "c", 1, "z", 1.0, None, None, t, "")]
    got = {(r.run, r.pos): (r.fused_rank, r.fused_score) for r in U.fuse(spark.createDataFrame(odd, SCHEMA), "run", ["run", "case"], "pos", "item", DIRECTIONS, "at").collect()}
    assert got["r", 4][0] == 1 and got["r", 3][0] == 2 and got["r", 2][0] == 3 and got["r", 1] == (4, None)
    assert U.fuse(spark.createDataFrame([], SCHEMA), "run", ["run", "case"], "pos", "item", DIRECTIONS, "at").count() == 0


def test_loadings_are_oriented():
    w = U.loadings(np.array([[1, 0.8, -0.7], [0.8, 1, -0.6], [-0.7, -0.6, 1.0]]))
    assert (w > 0.3).all() and w.sum() == pytest.approx(1)
    assert U.loadings(np.eye(2)).sum() == pytest.approx(1)
