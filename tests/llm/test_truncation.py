import random

import numpy as np
import pandas as pd
import pytest

from spanwise.llm import truncation as T

COMPLETE = [
    "It is done.", "It is done. [C3]", "It is done [C3].", "Is it?  ", "Stop! 🙂\n", "(It is.)", "He said “no.”", "これは適用されません。", "- queue revoked for Klouplin", "a.\n\nTags: fee, import", "a.\n\nSee also: Prepaid session",
    "a.\n\nBest regards,\nDepot Control", "a.\n\n— Risk Desk", "a.\n\n-- Risk\xa0Desk", "| a | b |\n|---|---|\n| x | y |", "```\na = 1\n```", "text.\n```\nx\nend\n``` 👍🏽", "closed numéro 38.", "It is done.&nbsp;", "fine. ðŸ™‚", "a.\n\nBe​st regards,\nRisk Desk",
]
CUT = ["It is do", "It is done. The ", "See the plan within 54", "| a | b |\n|---|---|\n| x | y |\n| z", "| a | b |\n|---|---|\n| x |", "```\na = 1\nb =", "The list, ", "Hello,\n\nThe Record", "この手順は", "the first (see", "canâ€™t be canc"]


@pytest.mark.parametrize("text", COMPLETE)
def test_complete_endings(text):
    assert T.ending(text)[0] in (*T.FINISHED, "number"), T.ending(text)


@pytest.mark.parametrize("text", CUT)
def test_cut_endings(text):
    assert T.ending(text)[0].startswith("open"), T.ending(text)


def lengths(seed, limit, share, n=3000, width=0):
    rng = np.random.default_rng(seed)
    x = np.maximum(1, rng.lognormal(6.3, 0.7, n)).astype(int)
    over = (x > limit) & (rng.random(n) < share)
    x[over] = limit - rng.integers(0, width + 1, over.sum())
    return x, over


@pytest.mark.parametrize(("limit", "share", "width"), [(1000, 0.9, 0), (700, 0.4, 0), (1500, 1.0, 24), (1200, 0.8, 3)])
def test_the_fit_finds_the_limit(limit, share, width):
    x, over = lengths(1, limit, share, width=width)
    at, n = np.unique(x, return_counts=True)
    assert limit in T.candidates(at, n.astype(float), width)
    ll, rho, p = T.fit_limit(at, n.astype(float), limit, width)
    assert ll > T.fit_none(at, n.astype(float)) + 20
    assert rho == pytest.approx(share, abs=0.1)
    assert float((p * n).sum()) == pytest.approx(over.sum(), rel=0.15)


def test_no_limit_is_seen_where_there_is_none():
    x, _ = lengths(2, 10**9, 0)
    at, n = np.unique(x, return_counts=True)
    base = T.fit_none(at, n.astype(float))
    for width in (0, 24):
        assert all(T.fit_limit(at, n.astype(float), c, width)[0] - base < 2 * np.log(len(x)) + 2 for c in T.candidates(at, n.astype(float), width))


def test_byte_limits_stand_at_their_upper_end():
    """Some complete texts just above must not draw the limit up."""
    x, _ = lengths(3, 1024, 1.0, width=0)
    at, n = np.unique(np.concatenate([x, [1026, 1027, 1027]]), return_counts=True)
    got = T._limits_of(("s",), pd.DataFrame({"unit": "bytes", "length": at, "n": n}))
    assert set(got["max_size"]) == {1024}


def test_a_source_has_several_limits():
    rng = np.random.default_rng(5)
    one, over = lengths(4, 900, 1.0)
    two, _ = lengths(5, 1500, 1.0, n=2000)
    at, n = np.unique(np.concatenate([one, two, rng.integers(1, 3000, 200)]), return_counts=True)
    table = pd.concat([pd.DataFrame({"unit": u, "length": at, "n": n}) for u in ("chars", "bytes")])
    got = T._limits_of(("s",), table)
    assert set(got["max_size"]) == {900, 1500}
    assert got[got["length"] == 900]["p"].max() > 0.9 and got[got["length"] == 1500]["p"].max() > 0.9


def test_weights_are_learned():
    """Sentences end as often at limits as elsewhere; open ones away from limits were cut in transfer."""
    rest, n_cut, n_complete, transfer = T.weights({"open_sentence": 90.0, "sentence": 10.0}, {"open_sentence": 45.0, "sentence": 955.0})
    assert rest["open_sentence"] == 0 and rest["sentence"] == pytest.approx(950, abs=1)
    assert (n_cut, transfer) == (100, pytest.approx(0.05, abs=0.001))
    assert T.weights({}, {})[1] == 0


def test_judge(spark):
    rnd = random.Random(6)
    rows, truth, i = [], set(), 0
    for source, limit, mark in (("mail", 400, ""), ("notes", 300, "..."), ("free", None, "")):
        for _ in range(400):
            n = max(4, int(rnd.lognormvariate(3.9, 0.6)))
            text = " ".join(" ".join(rnd.choice(["amber", "bolt", "cedar", "delta"]) for _ in range(6)).capitalize() + "." for _ in range(n // 6 + 1))
            if rnd.random() < 0.1:
                text += "\nLet me think about it…"
            i += 1
            if limit and len(text) > limit:
                short = text[: limit - len(mark)]
                if short.rstrip()[-1] not in ".…":
                    truth.add(i)
                text = short + mark
            rows.append((i, text, source))
    rows += [(9001, None, "mail"), (9002, "", "mail"), (9003, " \n​", "mail"), (9004, "Cut off in the mid", None), (9005, "Whole. " * 20_000, "mail"), (9004, "Cut off in the mid", None)]
    truth.add(9004)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, kind int")
    judged, limits = T.judge(df, "doc_id", "text", "source")
    found = {r.key for r in judged.where("cut").collect()}
    assert found == truth
    sizes = {r.source: (r.unit, r.max_size) for r in limits.select("source", "unit", "max_size").distinct().collect()}
    assert sizes["mail"][1] == 400 and sizes["notes"][1] == 300 and "free" not in sizes
    assert judged.count() == len(rows) - 3
    assert T.judge(df.limit(0), "doc_id", "text", "source")[0].count() == 0


def test_a_repeated_line_at_the_limit_stays_a_cut(spark):
    rnd = random.Random(8)
    rows = []

    def add(text):
        rows.append((len(rows), text, "feed"))
        return rows[-1][0]

    def prose(n):
        text = ""
        while len(text) < n:
            text += " ".join(rnd.choice(["amber", "bolt", "cedar", "delta"]) for _ in range(6)).capitalize() + ". "
        return text

    def ending_in(line, size):
        """A text of *size* characters whose last line is *line*."""
        rest = size - len(line) - 2
        return prose(rest)[:rest] + ".\n" + line

    for _ in range(600):
        text = prose(max(20, int(rnd.lognormvariate(5.3, 0.6))))
        add(text[:297] + "..." if len(text) > 300 else text)
    cut = {add(ending_in("As of version 9.2...", 300)) for _ in range(12)}
    done = {add(ending_in("Let me think about it...", rnd.randrange(60, 290))) for _ in range(40)} | {add(ending_in("Let me think about it...", 300))}
    judged, limits = T.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "doc_id", "text", "source")
    assert {r.max_size for r in limits.collect()} == {300}
    found = {r.key for r in judged.where("cut").collect()}
    assert cut <= found and not done & found
