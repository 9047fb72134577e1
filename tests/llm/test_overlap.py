import random
from fractions import Fraction

import pytest

from spanwise.llm import overlap as O
from spanwise.llm import p1
from spanwise.llm.words import words


def brute(rows, threshold):
    out = set()
    sets = [(o, s, f, frozenset(words(t))) for o, s, f, t in rows if o is not None and t is not None]
    for a in sets:
        for b in sets:
            if a[1] == "eval" and b[1] == "train" and a[2] == b[2] and a[3] and b[3] and len(a[3] & b[3]) >= threshold * len(a[3] | b[3]):
                out.add((a[0], b[0], a[2]))
    return out


def texts(seed):
    rnd = random.Random(seed)
    vocab = ["the", "a", "of"] + [f"w{i}" for i in range(60)]
    rows = []
    for g in range(40):
        base = rnd.sample(vocab, rnd.choice([1, 2, 3, 4, 7, 8, 12, 20]))
        for v in range(4):
            w = [x for x in base if rnd.random() > 0.08 * v] + rnd.sample(vocab, v % 3)
            rnd.shuffle(w)
            rows.append((f"c{g}{v}", rnd.choice(["train", "eval"]), rnd.choice(["query", "quote"]), " ".join(w).title()))
    odd = [("n", "eval", "query", None), ("e", "eval", "query", ""), ("p", "train", "query", "?!"), (None, "train", "query", "w1"), ("o", "other", "query", rows[0][3]), ("u", "eval", "query", "Ｗ1 w­2 é"), ("v", "train", "query", "w1 W2 é"), ("x", "eval", "quote", "alone"), ("y", "train", "quote", "alone")]
    return rows + odd + rows[:20]


@pytest.mark.parametrize("threshold", ["3/4", "1/2", "9/10"])
@pytest.mark.parametrize("grid", [60_000, 150])
def test_links_are_those_of_brute_force(spark, monkeypatch, threshold, grid):
    monkeypatch.setattr(O, "PASSAGES_PER_SHARD", grid)
    rows = texts(5)
    df = spark.createDataFrame([(*r, 1) for r in rows], "owner string, side string, field string, text string, cls int")
    classes, links = O.overlaps(df, df.select("owner", "side"), threshold)
    owners = {}
    for r in classes.collect():
        owners.setdefault((r.side, bytes(r.cls)), []).append((r.owner, r.field))
    got = {(a, b, f) for x in links.collect() for a, f in owners["eval", bytes(x.eval_cls)] for b, _ in owners["train", bytes(x.train_cls)]}
    assert got == brute(rows, Fraction(threshold)) and len(got) > 10


@pytest.mark.parametrize("side", ["train", "eval", None])
def test_empty_sides(spark, side):
    df = spark.createDataFrame([("a", side, "query", "one two three")] if side else [], "owner string, side string, field string, text string")
    classes, links = O.overlaps(df, df.select("owner", "side"))
    assert links.count() == 0 and classes.count() == (1 if side else 0)


def test_no_edit_breaks_more_passages_than_the_bound():
    rnd = random.Random(2)
    t = Fraction(3, 4)
    for _ in range(3000):
        vocab = [f"{i:02d}" for i in range(40)]
        e = set(rnd.sample(vocab, rnd.randint(1, 16)))
        o = {x for x in e if rnd.random() > 0.15} | set(rnd.sample(vocab, rnd.randint(0, 4)))
        if o and len(e & o) >= t * len(e | o):
            own, other = O.passages(" ".join(sorted(e))), set(O.passages(" ".join(sorted(o))))
            found = [i for i, p in enumerate(own) if p in other]
            assert len(found) >= O.least_passages(len(e), t) and 0 < O.coverage(found, len(e)) <= 1


def test_coverage_merges_intervals():
    assert O.coverage([0, 1, 2, 3, 4], 4) == 1.0
    assert O.coverage([2], 4) == 0.5
    assert O.coverage([1, 2], 4) == 0.75
    assert O.coverage([], 4) == 0.0


def test_coverage_comes_from_the_automaton():
    shard = O.build([(b"e", "a b c d", [0, 1], [0, 1, 2, 3])], Fraction(1, 2))
    assert list(O.matches(shard, "a b c x", Fraction(1, 2))) == [(b"e", 0.75, 0.6)]
    assert list(O.matches(shard, "d x y z", Fraction(1, 2))) == []


def test_passages_that_no_training_text_has_are_left_out():
    counts = O.np.zeros(O.SLOTS, int)
    for p, n in ((" a b ", 1), (" b c ", 5), (f" {O.OPEN} a ", 5)):
        counts[O.slot(p)] = n
    assert O.picks("a b c d", counts, Fraction(1, 2)) == ([1, 0, 2], [0, 1, 2])
    assert O.picks("x y z", counts, Fraction(1, 2)) == ([], [])


def test_counts_need_no_pairs(spark):
    """Cases with equal texts, cases with several, and a case of both sides."""
    rows = [("e1", "eval", "one two three four"), ("e2", "eval", "one two three four"), ("e3", "eval", "five six seven"), ("e3", "eval", "one two three four"), ("t1", "train", "one two three four"), ("t2", "train", "one two three four five"), ("t3", "train", "six seven five"), ("t3", "train", "one two three four"), ("b", "train", "one two three four"), ("b", "eval", "one two three four"), ("e4", "eval", "none of these")]
    texts = spark.createDataFrame([(o, "quote", x) for o, _, x in rows], "owner string, field string, text string")
    sides = spark.createDataFrame([(o, s) for o, s, _ in rows], "owner string, side string")
    classes, links = O.overlaps(texts, sides)
    pairs = {}
    for r in p1._pairs(classes, links).collect():
        pairs.setdefault(r.eval_case, set()).add(r.train_case)
    got = {r.case_id: (r.n_pairs, r.coverage) for r in p1._per_case(classes, links).collect()}
    assert {k: n for k, (n, _) in got.items()} == {"e1": 4, "e2": 4, "e3": 4, "b": 3, "e4": 0} == {k: len(pairs.get(k, ())) for k in got}
    assert got["e1"][1] == 1.0 and got["e4"][1] == 0.0
