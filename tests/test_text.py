import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanwise.functions import matchers
from spanwise.functions import spans as S
from spanwise.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items()))
    return df.select(column.alias("x")).head()[0]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("The fee is 2.9% + $0.30", ["fee", "2.9%", "$0.30"]),
        ("T+2 for PAY_003", ["t+2", "pay_003"]),
        ("not available, no fee", ["not", "available", "no", "fee"]),
        ("", []),
        (None, None),
    ],
)
def test_tokenize(spark, text, tokens):
    assert one(spark, T.tokenize("t"), t=text) == tokens


def test_numbers(spark):
    assert one(spark, T.numbers_in("t"), t="1,250 and 2.5%, not C9 or v1.2.3 but 500-widget, １２") == [1250.0, 2.5, 500.0, 12.0]
    assert one(spark, T.numbers_in("t"), t="[C9]") == []


def test_labels(spark):
    assert one(spark, T.extract_labels("t"), t="a [c1, C3] b [C1][C2].") == ["C1", "C3", "C2"]
    assert one(spark, T.strip_labels("t"), t="It costs $5 [C1]. Yes  [C2, C3] !") == "It costs $5. Yes!"


@pytest.mark.parametrize(
    ("answer", "abstains"),
    [
        ("The documentation provided does not answer this question.", True),
        ("The excerpts don't clearly state the fee [C1].", True),
        ("I do not know.", True),
        ("That is not documented.", True),
        ("The fee is not in the context.", True),
        ("We do not lend, but the rate is 2.9%.", False),
        ("The rate is 3%.", False),
        (None, None),
    ],
)
def test_abstention(spark, answer, abstains):
    assert one(spark, T.detect_abstention("t"), t=answer) is abstains


@pytest.mark.parametrize(("answer", "asks"), [("Which plan do you have?", True), ("It depends on your plan.", True), ("This depends on nothing.", False), ("Sure?", False)])
def test_clarification(spark, answer, asks):
    assert one(spark, T.detect_clarification("t"), t=answer) is asks


def test_claims_by_line_and_sentence():
    text = "The fee is 5 [C1]. It is due, e.g. Monday. and so on\n\n- One. Two [C2].\n  2) Three"
    found = T.claims_of(text)
    assert [c["text"] for c in found] == ["The fee is 5 [C1].", "It is due, e.g. Monday. and so on", "- One. Two [C2].", "2) Three"]
    assert [c["cited_labels"] for c in found] == [["C1"], [], ["C2"], []]
    assert T.claims_of("") == []


@given(st.text(alphabet="Ab.! \n-[C1]é🙂", max_size=60))
@settings(max_examples=200, deadline=None)
def test_claims_stand_at_their_places(text):
    found = T.claims_of(text)
    assert all(text[c["char_start"] : c["char_end"]] == c["text"] for c in found)
    assert all(a["char_end"] <= b["char_start"] for a, b in zip(found, found[1:], strict=False))


def test_facts_in_documents(spark):
    df = spark.createDataFrame([("A **2.9%** fee,  and `PAY_003`", "2.9% fee", ["nine"], []), ("nine units", "9", ["nine"], None), ("only 30", "x", [], ["30", "40"])], "body string, value string, aliases array<string>, parts array<string>")
    assert [r[0] for r in df.select(T.contains_fact(*(F.col(c) for c in df.columns))).collect()] == [True, True, False]


@pytest.mark.parametrize(
    ("matcher", "yes", "no"),
    [
        ({"kind": "literal", "value": "Blue"}, "a blue one", "red"),
        ({"kind": "literal", "value": "Blue", "case_sensitive": True}, "Blue", "blue"),
        ({"kind": "numeric", "value": 2.9}, "2.9 per cent", "2.95"),
        ({"kind": "numeric", "value": 10, "tolerance": 1}, "about 11", "12"),
        ({"kind": "regex", "pattern": "two|2"}, "TWO", "three"),
        ({"kind": "any_of", "matchers": [{"kind": "literal", "value": "a"}, {"kind": "numeric", "value": 1}]}, "1", "b"),
        ({"kind": "all_of", "matchers": [{"kind": "literal", "value": "a"}, {"kind": "numeric", "value": 1}]}, "a 1", "a"),
        ({"kind": "absent", "matcher": {"kind": "literal", "value": "old"}}, "new", "old"),
    ],
)
def test_matchers(spark, matcher, yes, no):
    assert one(spark, matchers.compile_matcher(matcher, F.col("t")), t=yes) is True
    assert one(spark, matchers.compile_matcher(matcher, F.col("t")), t=no) is False


def test_unknown_matcher_and_weights(spark):
    with pytest.raises(ValueError, match="unknown matcher"):
        matchers.compile_matcher({"kind": "fuzzy"}, F.col("t"))
    facts = [{"matcher": {"kind": "literal", "value": "a"}, "weight": 3}, {"matcher": {"kind": "literal", "value": "b"}}]
    assert one(spark, matchers.fact_coverage(facts, F.col("t")), t="a") == 0.75
    assert one(spark, matchers.fact_coverage([], F.col("t")), t="a") is None


def test_quotes_and_intervals(spark):
    df = spark.createDataFrame([("é🙂 the  fee\nis 5", "the fee is", 0), ("abc", "", 1), ("abc", None, 2), (None, "a", 3), ("café x", "café", 4)], "b string, q string, i int")
    assert [tuple(r.x) for r in df.select("i", S.resolve_quote("b", "q").alias("x")).orderBy("i").collect()] == [(3, 14), (-1, -1), (-1, -1), (-1, -1), (0, 4)]
    v = spark.createDataFrame([(0, 10, 10, 20), (0, 10, 5, 8), (5, 5, 0, 9)], "a int, b int, c int, d int")
    cols = [F.col(c) for c in "abcd"]
    assert [tuple(r) for r in v.select(S.spans_overlap(*cols), S.overlap_length(*cols), S.coverage_fraction(*cols), S.is_hit(*cols)).collect()] == [(False, 0, 0.0, False), (True, 3, 0.3, False), (True, 0, 0.0, False)]
