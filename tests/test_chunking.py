import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanwise.operators import chunking as C


def windows(body, size, overlap):
    out = []
    for s in range(0, max(len(body), 1), size - overlap):
        e = min(s + size, len(body))
        if body[s:e].strip():
            out.append((s, e))
        if e >= len(body):
            break
    return out


BODIES = {"a": "x" * 500, "b": "é🙂 b " * 300, "c": "", "d": "   ", "e": "short", "f": "y" * 950, "g": "z" * 951, "h": None}


@pytest.mark.parametrize(("size", "overlap"), [(500, 50), (100, 0), (7, 6)])
def test_fixed_size_is_the_sliding_window(spark, size, overlap):
    docs = spark.createDataFrame([(k, v, 1) for k, v in BODIES.items()], "doc_id string, body string, text int")
    got = C.fixed_size(docs, size, overlap).collect()
    assert {(r.doc_id, r.char_start, r.char_end) for r in got} == {(k, s, e) for k, v in BODIES.items() if v for s, e in windows(v, size, overlap)}
    for r in got:
        assert BODIES[r.doc_id][r.char_start : r.char_end] == r.text
        assert r.chunk_id == f"{r.doc_id}#{hashlib.sha1(r.text.encode()).hexdigest()[:8]}"
        assert r.token_count == int(len(r.text.split()) * 1.3) + 1


def test_arguments(spark):
    with pytest.raises(ValueError, match="overlap"):
        C.fixed_size(spark.createDataFrame([], "doc_id string, body string"), 10, 10)
    with pytest.raises(ValueError, match="unknown chunker"):
        C.build_chunker("semantic")
    assert C.build_chunker("fixed_size", chunk_size=10, chunk_overlap=2, min_chars=3)(spark.createDataFrame([("d", "0123456789abcdef")], "doc_id string, body string")).count() == 2


def test_structure_follows_headings():
    body = "lost\n# A\n" + "a" * 200 + "\n## B\nshort\n### C\n" + "c" * 150 + "\n# D\n" + "d" * 130 + "\n"
    got = C.structure(body)
    assert [p for _, _, p in got] == [["A"], ["A", "B", "C"], ["D"]]
    assert body[got[0][0] : got[0][1]].startswith("# A") and "short" in body[got[0][0] : got[0][1]]
    assert got[-1][1] == len(body) and got[0][0] == body.index("# A")
    assert C.structure("no heading") == []


def test_long_sections_break_at_blank_lines_and_spare_tables():
    text = "# A\n" + "p" * 300 + "\n\n" + "q" * 300 + "\n\n| a | b |\n| 1 | 2 |\n" + "r" * 900
    got = C.structure(text, 700, 10)
    assert text[got[0][1] :].startswith("\n\nqqq")
    assert all(e - s <= 700 for s, e, _ in got)
    assert "".join(text[s:e] for s, e, _ in got) == text


@given(st.text(alphabet="# \n|ab", max_size=400), st.integers(5, 60))
@settings(max_examples=300, deadline=None)
def test_structure_never_overlaps_nor_loses_text_after_a_heading(body, most):
    got = C.structure(body, most, 4)
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))
    m = C.HEADING.search(body)
    if m:
        held = set().union(*(range(s, e) for s, e, _ in got)) if got else set()
        assert all(i in held or body[i].isspace() for i in range(m.start(), len(body)))


def test_markdown_operator(spark):
    docs = spark.createDataFrame([("d", "# T\n" + "w " * 200, 1), ("e", "plain " * 300, 2), ("f", None, 3), ("g", "", 4)], "doc_id string, body string, char_start int")
    rows = C.markdown(docs).collect()
    assert {r.doc_id for r in rows} == {"d", "e"}
    assert [(r.char_start, r.char_end) for r in sorted(rows, key=lambda r: r.char_start) if r.doc_id == "e"] == [(0, 1200), (1200, 1800)]
    assert C.markdown(docs.limit(0)).count() == 0
