"""Required facts as column expressions: a matcher tree is compiled once, on the driver."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import numbers_in


def compile_matcher(matcher: Mapping, answer: Column) -> Column:
    """Whether *answer* satisfies a matcher: literal, numeric, regex, any_of, all_of or absent.

    literal ignores case unless case_sensitive; numeric holds for any number within the tolerance (at least
    a 1e-9 of the value); regex ignores case unless its flags lack "i"; absent turns its matcher round.
    A null answer matches like an empty one.  An unknown kind raises ValueError.
    """
    kind = matcher["kind"]
    text = F.coalesce(answer, F.lit(""))
    if kind == "literal":
        value = matcher["value"]
        return F.contains(text, F.lit(value)) if matcher.get("case_sensitive") else F.contains(F.lower(text), F.lit(value.lower()))
    if kind == "numeric":
        value = float(matcher["value"])
        most = max(float(matcher.get("tolerance") or 0), abs(value) * 1e-9)
        return F.exists(numbers_in(text), lambda n: F.abs(n - value) <= most)
    if kind == "regex":
        return F.rlike(text, F.lit(("(?iU)" if "i" in matcher.get("flags", "i") else "(?U)") + matcher["pattern"]))
    if kind in ("any_of", "all_of"):
        parts = [compile_matcher(m, answer) for m in matcher["matchers"]]
        return reduce(Column.__or__, parts, F.lit(False)) if kind == "any_of" else reduce(Column.__and__, parts, F.lit(True))
    if kind == "absent":
        return ~compile_matcher(matcher["matcher"], answer)
    raise ValueError(f"unknown matcher kind: {kind!r}")


def fact_coverage(facts: list[Mapping], answer: Column) -> Column:
    """Weighted share of facts ({"matcher": ..., "weight": 1.0}) that hold; NULL for no facts or no weight."""
    total = sum(float(f.get("weight", 1.0)) for f in facts)
    if not facts or not total:
        return F.lit(None).cast("double")
    return sum((F.when(compile_matcher(f["matcher"], answer), float(f.get("weight", 1.0))).otherwise(0.0) for f in facts), F.lit(0.0)) / total
