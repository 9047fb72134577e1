import random

import numpy as np
import pytest

from spanwise.llm import nearcopies as N
from spanwise.llm.words import words


def brute(rows, k, threshold, least):
    ts = {}
    for key, text in rows:
        w = words(text)
        if key is not None and len(w) >= max(least, k):
            ts.setdefault(key, set()).add(tuple(w))
    sh = lambda w: {w[i : i + k] for i in range(len(w) - k + 1)}
    out = set()
    keys = sorted(ts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if any(len(sh(x) & sh(y)) >= threshold * len(sh(x) | sh(y)) - 1e-9 for x in ts[a] for y in ts[b]):
                out.add((a, b))
    return out


def corpus(seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    phrase = "but we are told it would be done within some days".split()
    rows = []
    for g in range(12):
        base = [x for _ in range(8) for x in [*rnd.sample(vocab, 6), *(phrase if rnd.random() < 0.4 else [])]]
        for v in range(5):
            w = list(base)
            for _ in range(v * 2):
                i = rnd.randrange(len(w))
                w[i : i + 1] = rnd.choice([[], [rnd.choice(vocab)], [w[i], rnd.choice(vocab)]])
            if v == 4:
                w = w[len(w) // 2 :] + w[: len(w) // 2]
            rows.append((f"k{g:02d}{v}", " ".join(w)))
    rows += [("copy1", rows[0][1].upper() + "!"), ("copy2", rows[0][1]), ("short", "a b c"), ("null", None), ("empty", ""), (None, rows[0][1]), ("two", rows[7][1]), ("two", rows[20][1]), ("long", " ".join(rnd.choice(vocab) for _ in range(30_000)))]
    return rows + rows[:10]


@pytest.mark.parametrize(("k", "threshold"), [(3, 0.7), (5, 0.8)])
def test_pairs_are_those_of_brute_force(spark, k, threshold):
    rows = corpus()
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "id string, t string, cls string")
    members, links = N.near_pairs(df, "id", "t", k=k, threshold=threshold)
    got = {tuple(r) for r in N.expand(members, links).collect()}
    assert got == brute(rows, k, threshold, 15) and len(got) > 10
    groups = {r.key: r for r in N.groups(members, links).collect()}
    for a, b in got:
        if "two" not in (a, b):
            assert groups[a].group_id == groups[b].group_id
    assert groups["long"].n_links == 0 and groups["long"].group_id == "long" and "short" not in groups


def test_empty_and_unmatched(spark):
    df = spark.createDataFrame([("a", "only one text of " + " ".join(map(str, range(30))))], "id string, t string")
    for some in (df, df.limit(0)):
        members, links = N.near_pairs(some, "id", "t")
        assert N.expand(members, links).count() == 0 and links.count() == 0
        assert N.groups(members, links).count() == some.count()


def test_sketch_keeps_order_and_labels_occurrences():
    h = N.Hasher()
    t = N.Texts([h("a b c a b c a b c x".split()), h("a b c x".split())], 3)
    labelled, n = t.labelled()
    assert len(set(labelled[: t.sizes[0]].tolist())) == t.sizes[0] and n.tolist() == [4, 2]
    w = [f"w{i}" for i in range(40)]
    s, _ = N.sketches(N.Texts([h(w), h(w), h(w[::-1]), h(w[:20] + ["new"] + w[20:])], 3), 2, 64)
    assert (s[0] == s[1]).all() and (s[0] == s[2]).mean() < 0.05 and (s[0] == s[3]).mean() > 0.6
    single, _ = N.sketches(N.Texts([h("a b c".split())], 3), 2, 4)
    assert single.shape == (1, 4)


def test_repeated_passages_meet_in_the_last_third():
    h, w = N.Hasher(), [f"w{i}" for i in range(40)]
    s, _ = N.sketches(N.Texts([h(w), h(w * 6)], 3), 2, 24)
    assert (s[0] == s[1])[16:].mean() > 0.7 and (s[0] == s[1])[:16].mean() < 0.3


def test_alignment_is_banded():
    a = [str(i) for i in range(60)]
    assert N.aligned_share(a, a, 5) == 1.0
    assert N.aligned_share(a, a[:30] + ["x"] + a[31:], 5) == pytest.approx(59 * 2 / 120)
    assert N.aligned_share(a, a[30:] + a[:30], 5) < 0.2 < N.aligned_share(a, a[30:] + a[:30], 60)
    assert N.aligned_share([], a, 5) == 0.0


@pytest.mark.parametrize(("most", "family"), [(10, 10), (10, 25), (200, 80), (200, 400)])
def test_a_large_family_keeps_its_links(spark, monkeypatch, most, family):
    """The edits of each member are its own, so most of what a member has alone is rare, and what it shares common."""
    monkeypatch.setattr(N, "MOST_IN_BUCKET", most)
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for v in range(family):
        w = list(base)
        for i in rnd.sample(range(100), 2):
            w[i] = f"own{v}at{i}"
        rows.append((f"m{v:04d}", " ".join(w)))
    rows += [(f"o{v:02d}", " ".join([*base[:35], *(f"other{v}at{i}" for i in range(65))])) for v in range(60)]
    members, links = N.near_pairs(spark.createDataFrame(rows, "id string, t string"), "id", "t", k=3, threshold=0.7)
    got = {tuple(r) for r in N.expand(members, links).collect()}
    if family <= 80:
        assert got == brute(rows, 3, 0.7, 15)
    # two words changed in each: at most 12 of 98 k-mers differ on either side
    assert got == {(f"m{i:04d}", f"m{j:04d}") for j in range(family) for i in range(j)}


def test_prefixes_of_a_pair_meet_whatever_the_counts():
    rnd, h = random.Random(4), N.Hasher()
    for _ in range(200):
        a = [f"w{rnd.randrange(30)}" for _ in range(40)]
        b = [x if rnd.random() < 0.94 else "new" for x in a]
        texts = N.Texts([h(a), h(b)], 3)
        x, y = ({tuple(t[i : i + 3]) for i in range(38)} for t in (a, b))
        hot = np.unique(texts.kmers)[::2]
        text, kmer, _, n = N.prefixes(texts, hot, np.arange(len(hot)) + 20, 0.7)
        meet = set(kmer[text == 0].tolist()) & set(kmer[text == 1].tolist())
        assert meet or len(x & y) < 0.7 * len(x | y) - 1e-9
        assert set(n.tolist()) <= {len(x), len(y)}
        m = N.marks(texts)
        assert sum(int(v).bit_count() for v in m[0] ^ m[1]) <= len(x ^ y)
