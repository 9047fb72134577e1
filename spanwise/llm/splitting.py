"""Splitting oversized texts at natural boundaries.

A text is cut into sections at Markdown headings, and a section that exceeds
the limit into pieces.  The separators form a hierarchy: paragraph, line,
sentence, word, character.  A unit that is too large is replaced by the units of
the next level, recursively; then units are packed greedily until the limit, and
each piece begins with the trailing *overlap* code points of the piece before.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADING = regex.compile(r"(#{1,6})[ \t](.*)")
#: Ends of units by level.  Each match's end is a place to cut.
LEVELS = [
    regex.compile(r"\r?\n(?:[ \t]*\r?\n)+"),  # paragraph
    regex.compile(r"\n"),  # line
    regex.compile(r"[.!?…]+[)\]\"'”’»]*(?:[ \t]*\[C\d+\])*\s+|[。！？]+[」』）]*\s*"),  # sentence
    regex.compile(r"\s+|(?<=[。、，；：])"),  # word
]
#: Characters that belong to the one before: a cut before them would tear a visible character apart.
JOINER = "\u200d"


def sections(body: str) -> list[tuple[int, int, int, str | None]]:
    """(start, end, level, title) of each section, in order; level 0 and no title before the first heading.

    Lines end with ``\\n``.  A heading line starts with one to six ``#`` and a blank or tab, outside
    code blocks, which open and close with a line that starts with three backticks.
    """
    marks: list[tuple[int, int, str | None]] = []
    at, code = 0, False
    for line in body.split("\n"):
        if line.startswith("```"):
            code = not code
        elif not code and line.startswith("#") and (m := HEADING.match(line)):
            marks.append((at, len(m[1]), m[2].strip().rstrip("#").strip()))
        at += len(line) + 1
    if not marks or marks[0][0] > 0:
        marks.insert(0, (0, 0, None))
    ends = [m[0] for m in marks[1:]] + [len(body)]
    return [(s, e, level, title) for (s, level, title), e in zip(marks, ends, strict=True)]


def heading_paths(parts: list[tuple[int, int, int, str | None]]) -> list[list[str]]:
    stack: list[tuple[int, str]] = []
    paths = []
    for _, _, level, title in parts:
        if level:
            stack = [x for x in stack if x[0] < level] + [(level, title or "")]
        paths.append([t for _, t in stack if t])
    return paths


def _visible(text: str, at: int, start: int) -> int:
    """The last place at or before *at*, after *start*, that does not tear a visible character apart."""
    cut = at
    while cut > start + 1 and cut < len(text) and (
        unicodedata.combining(text[cut]) or text[cut] in (JOINER, "\ufe0f") or text[cut - 1] == JOINER or "\U0001f3fb" <= text[cut] <= "\U0001f3ff" or (text[cut] == "\n" and text[cut - 1] == "\r")
    ):
        cut -= 1
    return cut if cut > start + 1 else at


def units(text: str, start: int, end: int, most: int, level: int = 0) -> Iterator[int]:
    """Ends of units of at most *most* code points that together make up text[start:end]."""
    if end - start <= most:
        if end > start:
            yield end
        return
    if level == len(LEVELS):
        at = start
        while end - at > most:
            at = _visible(text, at + most, at)
            yield at
        yield end
        return
    at = start
    for m in LEVELS[level].finditer(text, start, end):
        if m.end() > at:
            yield from units(text, at, m.end(), most, level + 1)
            at = m.end()
    if at < end:
        yield from units(text, at, end, most, level + 1)


def pieces(text: str, start: int, end: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of pieces of text[start:end], each at most *limit* long.

    Consecutive pieces share exactly *overlap* code points; together they leave out nothing.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    if end - start <= limit:
        return [(start, end)]
    out, first, last = [], start, start
    for cut in units(text, start, end, limit - overlap):
        if cut - first > limit:
            out.append((first, last))
            first = last - overlap
        last = cut
    out.append((first, last))
    return out


def _batches(df: DataFrame, key: str, body: str, run, schema: str) -> DataFrame:
    src = df.select(df[key].cast("string").alias("key"), df[body].cast("string").alias("body")).where(F.length("body") > 0)
    return src.mapInArrow(run, schema).distinct()


def find_sections(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, section_start, section_end, heading_path) of every section of every non-empty body.

    Rows delivered twice count once; null and empty bodies have no sections; a null key is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, ends, paths = [], [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = sections(text)
                for (s, e, _, _), path in zip(parts, heading_paths(parts), strict=True):
                    keys.append(k)
                    starts.append(s)
                    ends.append(e)
                    paths.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(paths, pa.list_(pa.string()))], [key, "section_start", "section_end", "heading_path"])

    return _batches(df, key, body, run, f"`{key}` string, section_start int, section_end int, heading_path array<string>")


def split(df: DataFrame, key: str, body: str, limit: int, overlap: int, with_text: bool = False) -> DataFrame:
    """(key, char_start, char_end, heading_path, section_start, piece[, text]): every section in pieces within *limit*.

    A section within the limit is one piece.  Offsets are half-open code points of the body.  Pieces
    of a section cover it without gaps and overlap by exactly *overlap*; they do not reach over a
    heading.  Edge cases as in ``find_sections``.
    """
    pieces("", 0, 0, limit, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = sections(text)
                for (s, e, _, _), path in zip(parts, heading_paths(parts), strict=True):
                    for n, (a, z) in enumerate(pieces(text, s, e, limit, overlap)):
                        for col, v in zip(cols, (k, a, z, path, s, n, text[a:z] if with_text else None), strict=True):
                            col.append(v)
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.string()]
            names = [key, "char_start", "char_end", "heading_path", "section_start", "piece", "text"]
            n = 7 if with_text else 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], kinds, strict=False)], names[:n])

    return _batches(df, key, body, run, f"`{key}` string, char_start int, char_end int, heading_path array<string>, section_start int, piece int" + ", text string" * with_text)
