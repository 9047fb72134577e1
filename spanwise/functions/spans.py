"""Half-open character intervals: all positions are 0-based code points."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def spans_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Touching spans do not overlap."""
    return (s1 < e2) & (s2 < e1)


def coverage_fraction(es: Column, ee: Column, rs: Column, re_: Column) -> Column:
    """Share of the evidence [es, ee) inside [rs, re_); 0 for empty evidence."""
    return F.when(ee - es <= 0, 0.0).otherwise(overlap_length(es, ee, rs, re_) / (ee - es))


def is_hit(es: Column, ee: Column, rs: Column, re_: Column, threshold: float = 0.5) -> Column:
    return coverage_fraction(es, ee, rs, re_) >= threshold


def find_exact(body: Column, quote: Column) -> Column:
    """Start of the first verbatim occurrence, -1 if there is none; -1 for an empty quote."""
    return F.when(F.length(quote) > 0, F.instr(body, quote) - 1).otherwise(-1)


def _resolve(body: str | None, quote: str | None) -> tuple[int, int]:
    if not body or not quote or not quote.strip():
        return -1, -1
    body, quote = unicodedata.normalize("NFC", body), unicodedata.normalize("NFC", quote)
    at = body.find(quote)
    if at >= 0:
        return at, at + len(quote)
    words = [re.escape(w) for w in quote.split()]
    m = re.search(r"\s+".join(words), body)
    return m.span() if m else (-1, -1)


PLACE = ST.StructType([ST.StructField("char_start", ST.IntegerType()), ST.StructField("char_end", ST.IntegerType())])


@F.pandas_udf(PLACE)
def resolve_quote(body: pd.Series, quote: pd.Series) -> pd.DataFrame:
    """Where a quote stands in a body: verbatim, else up to white space; (-1, -1) if nowhere.

    Both are compared in normal form C, so positions are those of the body in that form.
    """
    body, quote = body.astype(object).where(body.notna(), None), quote.astype(object).where(quote.notna(), None)
    return pd.DataFrame([_resolve(b, q) for b, q in zip(body, quote, strict=True)], columns=["char_start", "char_end"])
