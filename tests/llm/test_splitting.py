import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanwise.llm import splitting as S


def test_sections_and_code_blocks():
    body = "lead\n# A\ntext\n```\n# no heading\n```\n## B \r\n#no\n####### no\n#\tC"
    got = S.sections(body)
    assert [(body[s:e].split("\n")[0].strip(), t) for s, e, _, t in got] == [("lead", None), ("# A", "A"), ("## B", "B"), ("#\tC", "C")]
    assert S.heading_paths(got) == [[], ["A"], ["A", "B"], ["C"]]
    assert S.sections("```\n# open") == [(0, 10, 0, None)]
    assert S.sections("# only") == [(0, 6, 1, "only")]


TEXT = st.text(alphabet="ab .\n|#é🙂́。-", max_size=300)


@given(TEXT, st.integers(2, 60), st.integers(0, 50))
@settings(max_examples=500, deadline=None)
def test_pieces_cover_all_within_the_limit_and_overlap_exactly(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    got = S.pieces(text, 0, len(text), limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(e - s <= limit for s, e in got)
    assert all(b[0] == a[1] - overlap and b[1] > a[1] for a, b in zip(got, got[1:], strict=False))


def test_pieces_end_at_natural_places():
    text = "One two. " * 30 + "\n\n" + "Three four five. " * 30
    ends = [e for _, e in S.pieces(text, 0, len(text), 200, 20)][:-1]
    assert all(text[:e].rstrip().endswith(".") for e in ends)
    assert 502 in [e for _, e in S.pieces("word " * 100 + "\n\n" + "x " * 50, 0, 602, 550, 0)]
    assert S.pieces("a" * 25, 0, 25, 10, 2) == [(0, 8), (6, 16), (14, 24), (22, 25)]
    with pytest.raises(ValueError, match="overlap"):
        S.pieces("x", 0, 1, 5, 5)


def test_operators(spark):
    long = "# H\n" + "word. " * 400
    rows = [("d", long, "x"), ("d", long, "x"), ("e", None, "x"), ("f", "", "x"), ("g", "short", "x"), (None, "# N\n" + "y" * 1300, "x")]
    df = spark.createDataFrame(rows, "doc_id string, body string, section_start string")
    cut = S.split(df, "doc_id", "body", 1200, 120).where("piece = 1").collect()
    assert sorted(((r.doc_id, r.section_start) for r in cut), key=str) == [("d", 0), (None, 0)]
    got = S.split(df, "doc_id", "body", 1200, 120, with_text=True).collect()
    assert {r.doc_id for r in got} == {"d", "g", None}
    assert all(r.text == long[r.char_start : r.char_end] and r.heading_path == ["H"] for r in got if r.doc_id == "d")
    assert sum(r.doc_id == "d" for r in got) == 3
    assert S.split(df.limit(0), "doc_id", "body", 10, 1).count() == 0
