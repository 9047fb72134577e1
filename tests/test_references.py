import datetime as dt
import random

from pyspark.sql import functions as F

from spanwise.operators import references as R
from spanwise.operators.components import connected_components

DAY = dt.datetime(2026, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(hours=8 * n)


def make(spark, refs, parents):
    c = F.col
    r = spark.createDataFrame([(i, k, day(t), 0) for i, k, t in refs], "id bigint, key string, at timestamp_ntz, t int")
    p = spark.createDataFrame([(k, day(a), day(z), "x") for k, a, z in parents], "key string, start timestamp_ntz, stop timestamp_ntz, kind string")
    return R.reference_events(r, "f", c("id"), c("key"), c("at")).unionByName(R.parent_events(p, "f", c("key"), c("start"), c("stop")))


def there(key, t, parents):
    return any(k == key and a is not None and t is not None and a <= t and (z is None or t < z) for k, a, z in parents)


def random_case(seed, hot=False):
    rnd = random.Random(seed)
    keys = ["", "a", "b", "c", None, "hot"]
    pick = lambda: "hot" if hot and rnd.random() < 0.6 else rnd.choice(keys)
    parents = [(pick(), rnd.choice([*range(40), None]), rnd.choice([*range(60), None])) for _ in range(25)]
    refs = [(i, pick(), rnd.choice([*range(60), None])) for i in range(120)]
    return refs + refs[:20], parents + parents[:5]


def test_orphans_match_brute_force(spark):
    for seed in range(3):
        refs, parents = random_case(seed, hot=seed == 2)
        got = {r.ref_id: r.orphan for r in R.orphan_references(make(spark, refs, parents)).collect()}
        assert got == {i: not there(k, t, parents) for i, k, t in refs if k is not None}


def test_start_is_included_and_stop_is_not(spark):
    got = R.orphan_references(make(spark, [(1, "a", 4), (2, "a", 7), (3, "a", 3)], [("a", 4, 7), ("a", 9, 5)])).collect()
    assert {r.ref_id: r.orphan for r in got} == {1: False, 2: True, 3: True}


def test_pending_at_the_end_of_periods(spark):
    refs, parents = random_case(7)
    refs = [r for r in refs if r[2] is not None]
    got = {r.period: (r.n_references, r.n_pending) for r in R.pending_by_period(make(spark, refs, parents), "day").collect()}
    real = [p for p in parents if p[2] is None or p[1] is None or p[2] > p[1]]
    for period, (n, pending) in got.items():
        end = period + dt.timedelta(days=1)
        mine = {(i, k, t) for i, k, t in refs if k is not None and day(t) < end}
        last = lambda k: any(q == k and a is not None and day(a) < end and (z is None or day(z) >= end) for q, a, z in real)
        assert pending == sum(not last(k) for _, k, _ in mine)
        assert n == sum(day(t) >= period for _, _, t in mine)


def test_any_batches_in_any_order_give_the_same_state(spark):
    refs, parents = random_case(11, hot=True)
    whole = {i: not there(k, t, parents) for i, k, t in refs if k is not None}
    seen = set()
    for seed in range(2):
        events = make(spark, refs, parents).withColumn("batch", F.pmod(F.xxhash64("t", "ref_id", "key", "kind", F.lit(seed)), F.lit(4))).cache()
        if seed:  # deletions last
            events = events.withColumn("batch", F.when(F.col("delta") < 0, 3).otherwise(F.col("batch"))).cache()
        state, life = None, {}
        for n in range(4):
            state, changed = R.advance(state, events.where(F.col("batch") == n))
            for r in changed.collect():
                life.setdefault(r.ref_id, []).append(r.status)
        assert {r.ref_id: r.orphan for r in state.refs.collect()} == whole
        assert {i: x[-1] in ("orphan", "reopened") for i, x in life.items()} == whole
        assert all(x[0] in ("orphan", "met") and all(a != b for a, b in zip(x, x[1:], strict=False)) for x in life.values())
        seen |= {s for x in life.values() for s in x}
        snapshot = state.snapshot.collect()[0]
        assert (snapshot.n_references, snapshot.n_waiting) == (len(whole), sum(whole.values()))
    assert seen == {"orphan", "met", "resolved", "reopened"}
    assert {r.ref_id: r.orphan for r in R.follow(make(spark, refs, parents)).refs.collect()} == whole


def test_a_reference_that_comes_again_counts_once(spark):
    refs, parents = random_case(5)
    events = make(spark, refs, parents)
    state, _ = R.advance(None, events)
    again, changed = R.advance(state, events.where(F.col("kind") == R.REFERENCE))
    assert changed.count() == 0
    assert sorted(map(str, again.refs.collect())) == sorted(map(str, state.refs.collect()))


def test_what_is_forgotten_is_not_needed(spark):
    refs, parents = random_case(11)
    refs = [r for r in refs if r[2] is not None]
    events = make(spark, refs, parents)
    cut = day(30)
    first, _ = R.advance(None, events.where(F.col("t") < F.lit(cut)))
    small = R.forget(first, str(cut))
    assert small.refs.count() == 0 and small.changes.groupBy("key").count().where("count > 1").count() == 0
    last, _ = R.advance(small, events.where(F.col("t") >= F.lit(cut)))
    got = {r.ref_id: r.orphan for r in first.refs.collect()} | {r.ref_id: r.orphan for r in last.refs.collect()}
    assert got == {i: not there(k, t, parents) for i, k, t in refs if k is not None}


def test_a_hot_key_is_cut_into_slices(spark):
    refs = [(i, "hot", i % 977) for i in range(3000)]
    parents = [("hot", 3 * i, 3 * i + 1 + i % 3) for i in range(300)]
    got = {r.ref_id: r.orphan for r in R.orphan_references(make(spark, refs, parents)).collect()}
    assert got == {i: not there(k, t, parents) for i, k, t in refs}


def test_empty_tables(spark):
    assert R.orphan_references(make(spark, [], [])).count() == 0
    assert R.pending_by_period(make(spark, [], [])).count() == 0
    assert {r.orphan for r in R.orphan_references(make(spark, [(1, "a", 1)], [])).collect()} == {True}


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(40)] + [(5, 5), (None, 3), (7, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {}
    for x in list(root):
        want.setdefault(find(x), set()).add(x)
    want = {min(v): v for v in want.values() if len(v) > 1}
    got = {}
    for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert got == want
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0
