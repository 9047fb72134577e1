import random
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanwise.llm import packing as P


def check(planned, counts, capacity):
    held = Counter()
    for content, n in planned:
        assert n > 0 and sum(s * m for s, m in content) <= capacity
        for s, m in content:
            held[s] += m * n
    assert held == Counter({i: int(c) for i, c in enumerate(counts) if c and i})


@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 30)), max_size=25))
@settings(max_examples=100, deadline=None)
def test_plans_hold_every_item_once(pairs):
    counts = np.zeros(41, np.int64)
    for s, n in pairs:
        counts[s] += n
    check(P.best_fit(counts, 40), counts, 40)
    patterns, rest = P.plan(counts, 40)
    assert all(sum(s * m for s, m in content) == 40 for content, _ in patterns)
    check(patterns + rest, counts, 40)


def test_patterns_enter_until_none_lessens_the_error():
    """Against the best of all patterns, enumerated."""
    counts = np.array([0, 0, 0, 9, 5, 0, 1, 4, 0, 0, 5.0])
    chosen, x = P.fit_repeats(counts)
    every = [c for n in range(1, 5) for c in combinations_with_replacement([10, 7, 6, 4, 3], n) if sum(c) == 10]
    left = counts - sum(v * np.bincount(c, minlength=11) for c, v in zip(chosen, x, strict=True))
    assert (x > 0).all() and len(chosen) <= 5
    assert max(left[list(c)].sum() for c in every) <= 1e-3
    assert max(abs(left[list(c)].sum()) for c in chosen) <= 1e-6
    assert P.best_pattern(np.array([0, 1.0, 5, 0, 0, 0]), np.array([1, 2])) == (11.0, [2, 2, 1])
    assert P.best_pattern(np.zeros(6), np.array([4])) == (0.0, [])


def test_patterns_carry_the_load():
    """Many sizes, eight to a container, as in the texts: patterns place most items, and no room is wasted."""
    rnd = np.random.default_rng(4)
    counts = np.bincount(np.clip(rnd.lognormal(5.2, 0.8, 20_000).astype(int), 1, 2048), minlength=2049)
    patterns, rest = P.plan(counts, 2048)
    check(patterns + rest, counts, 2048)
    placed = sum(n * sum(m for _, m in content) for content, n in patterns)
    assert placed >= 0.8 * counts.sum()
    assert sum(n for _, n in patterns + rest) <= -(-int((counts * np.arange(2049)).sum()) // 2048) * 1.001 + 1


def test_best_fit_equals_item_by_item():
    rnd = random.Random(3)
    for _ in range(50):
        items = sorted((rnd.randint(1, 30) for _ in range(rnd.randint(1, 60))), reverse=True)
        rooms = []
        for s in items:
            fit = [r for r in rooms if r >= s]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else 30) - s)
        assert sum(n for _, n in P.best_fit(np.bincount(items, minlength=31), 30)) == len(rooms)


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(P, "ITEMS_PER_SHARD", 40)
    rnd = random.Random(5)
    rows = [(i, rnd.choice([rnd.randint(1, 100), rnd.randint(100, 900), 333, 0]), "x") for i in range(600)] + [(900, 5000, "x"), (901, 2000, "x"), (902, None, "x"), (None, 7, "x"), (5, 9, "x")]
    got = P.pack(spark.createDataFrame(rows, "doc bigint, n bigint, container string"), "doc", "n", 1000).collect()
    load, parts = Counter(), defaultdict(list)
    for r in got:
        load[r.container] += r.size
        parts[r.doc].append((r.piece, r.start, r.size))
    assert max(load.values()) <= 1000
    total = sum(n or 0 for _, n, _ in rows)
    assert sum(load.values()) == total and len([c for c, v in load.items() if v]) <= -(-total // 1000) + 2
    assert sorted(parts[900]) == [(i, i * 1000, 1000) for i in range(5)] and sorted(parts[901]) == [(0, 0, 1000), (1, 1000, 1000)]
    assert parts[902] == [(0, 0, 0)] and len(parts[5]) == 2 and parts[None] == [(0, 0, 7)]
    assert len(got) == len(rows) + 5
    assert set(load) == set(range(max(load) + 1))


def test_pack_nothing(spark):
    df = spark.createDataFrame([], "doc bigint, n bigint")
    assert P.pack(df, "doc", "n", 10).count() == 0
    zero = spark.createDataFrame([(1, 0), (2, None)], "doc bigint, n bigint")
    assert {r.container for r in P.pack(zero, "doc", "n", 10).collect()} == {0}
    with pytest.raises(ValueError, match="capacity"):
        P.pack(df, "doc", "n", 0)
