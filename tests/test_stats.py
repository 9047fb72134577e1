import random

import numpy as np
import pytest

from spanwise.operators import stats as G


def test_parts_draw_the_same_stream_as_one_call():
    d = np.random.default_rng(0).normal(size=1700)
    whole = np.random.default_rng(5).choice(d, size=(3000, 1700), replace=True).mean(axis=1)
    assert G.bootstrap_interval(d, 3000, 5) == pytest.approx((d.mean(), *np.percentile(whole, [2.5, 97.5])))


def arms(spark, b, i):
    row = lambda x: spark.createDataFrame([(k, v, None if v is None else v > 0) for k, v in x.items()], "case_id string, m double, ok boolean")
    return row(b), row(i)


def test_pairs_are_by_case_and_defined_in_both(spark):
    b, i = arms(spark, {"a": 0.0, "b": 1.0, "c": None, "d": 0.5, "only": 1.0}, {"d": 0.7, "c": 1.0, "b": 1.0, "a": 0.5})
    assert {(r.metric, r.case_id, r.baseline, r.improved) for r in G.pair(b, i, ["m", "ok"]).collect()} == {("m", "a", 0, 0.5), ("m", "b", 1, 1), ("m", "d", 0.5, 0.7), ("ok", "a", 0, 1), ("ok", "b", 1, 1), ("ok", "d", 1, 1)}


def test_exact_and_poisson_comparisons(spark):
    rnd = random.Random(2)
    b = {f"c{i:03d}": rnd.random() for i in range(60)}
    i = {k: v + 0.2 + rnd.gauss(0, 0.1) for k, v in b.items()}
    pairs = G.pair(*arms(spark, b, i), ["m"])
    exact, poisson = G.compare_exact(pairs).head(), G.compare_poisson(pairs).head()
    d = np.array([i[k] - b[k] for k in sorted(b)])
    draws = np.random.default_rng(G.SEED).choice(d, size=(10_000, 60), replace=True).mean(axis=1)
    assert (exact.delta, exact.ci_low, exact.ci_high) == pytest.approx((d.mean(), *np.percentile(draws, [2.5, 97.5])))
    assert exact.direction == poisson.direction == "improved" and exact.ci_excludes_zero
    assert poisson.ci_low == pytest.approx(exact.ci_low, abs=0.02) and poisson.ci_high == pytest.approx(exact.ci_high, abs=0.02)


def test_few_pairs_and_touching_zero(spark):
    two = G.compare_exact(G.pair(*arms(spark, {"a": 1.0, "b": 1.0}, {"a": 0.0, "b": 0.0}), ["m"])).head()
    assert (two.n_paired, two.direction, two.ci_low) == (2, "insufficient data", None)
    same = G.compare_exact(G.pair(*arms(spark, dict.fromkeys("abcd", 1.0), dict.fromkeys("abcd", 1.0)), ["m"])).head()
    assert same.direction == "no measurable difference" and not same.ci_excludes_zero
    worse = G.compare_exact(G.pair(*arms(spark, dict.fromkeys("abcd", 1.0), dict.fromkeys("abcd", 0.5)), ["m"])).head()
    assert worse.direction == "regressed"


def test_order_statistics_are_those_of_the_sorted_list(spark):
    rnd = random.Random(4)
    data = [("a", rnd.choice([rnd.uniform(0, 500), 100.0])) for _ in range(301)] + [("b", 7.0), ("c", None)]
    got = {r.g: r for r in G.order_statistics(spark.createDataFrame(data, "g string, v double"), ["g"], "v", {"p50": 0.5, "p95": 0.95, "top": 1.0}).collect()}
    v = sorted(x for g, x in data if g == "a")
    assert (got["a"].n, got["a"].p50, got["a"].p95, got["a"].top) == (301, v[150], v[int(301 * 0.95)], v[-1])
    assert got["b"].p95 == 7.0 and "c" not in got


def test_mean_interval_and_summary(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("x", None), ("x", 4.0), ("y", 1.0)], "g string, v double")
    rows = {r.g: r for r in G.mean_interval(df, ["g"], "v", 500).collect()}
    assert rows["x"].n == 3 and rows["x"].ci_low <= rows["x"].mean <= rows["x"].ci_high and rows["y"].ci_low is None
    assert {(r.g, r.n, round(r["mean"], 9)) for r in G.summarise(df, ["g"], ["v"]).collect()} == {("x", 3, round(7 / 3, 9)), ("y", 1, 1.0)}
