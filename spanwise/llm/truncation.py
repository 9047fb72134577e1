"""Texts that were cut off: by a field limit of their source, or in transfer.

Each source's lengths are a log-normal distribution, some of whose texts were
cut at unknown limits: a length near a limit then is right-censored.  The
limits, their unit (characters or bytes) and how far below them cuts fall (whole
words, whole characters) are found by maximum likelihood against no limit; the
fit gives the chance that a text of a certain length was cut there.  How much
likelier each ending is in a cut text than in a complete one is learned from
that: from the texts at limits against those away from them.  Both are added as
log odds.  A text that was cut exactly behind a finished sentence, row, list
item or code block was cut inside nothing, and is no case.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import materialise
from .words import INVISIBLE

#: Kinds of endings by what the text ends in.  The first of each is the typical ending of a text cut there: complete
#: texts do not have it, so those that have it away from limits were cut in transfer.  Fixed values.
PLACES = {
    "code": ("open_code", "code"),  # a code block that does not close; one that does
    "table": ("open_row", "row"),  # a row without its last border, or with cells missing
    # dots inside a paragraph, as put behind a cut; a short line of its own that trails off; one that other texts away from limits end in too
    "dots": ("dots_inside", "dots_line", "dots_phrase"),
    # open_item: a list item or footer that stops after a joining word or mark; number: an end, or half of a decimal
    "prose": ("open_sentence", "open_item", "number", "heading", "item", "footer", "sentence"),
}
KINDS = [k for kinds in PLACES.values() for k in kinds]
#: Behind these nothing is left open: by definition no case.  Fixed values.
FINISHED = ("code", "row", "item", "footer", "sentence")
SMOOTHING = 0.1
"""Added to the number of texts of each kind, cut and complete."""
LEAST_SHARE = (0.1, 0.3)
"""A length is a source's first limit, or a further one, only if it cut so large a share of the texts that exceeded it:
forms of equal length make spikes too."""
#: Widths of the range below a limit in which cut texts end: exact; up to a character's bytes; whole words.
WIDTHS = {"chars": (0, 24), "bytes": (3,)}
#: How fast the chance falls with the distance below the limit: candidates, the best of which is taken.
FALLS = (0.01, 0.1, 0.3, 0.5, 0.7, 0.85, 0.95, 1.0)

_TAIL = re.compile("[\\s\U0001f000-\U0001faff☀-➿‍︎️⃣]+$")
_DOTS = re.compile(r"(?:\.\.\.+|…)[)\]\"'”’»]*$")
_END = re.compile(r"[.!?。！？．][)\]}\"'”’»」』）*_`]*(?:\s*\[[A-Za-z]\d+\][.!?]?)*$|\[[A-Za-z]\d+\]$")
_NUMBER = re.compile(r"(?:^|[\s(])[\d.,]*\d\.$")
_LINK = re.compile(r"(?:https?://|www\.)\S*$")
_RULE = re.compile(r"\|?\s*:?-{3,}.*\|")
_ITEM = re.compile(r"(?:[-*•–]|\d+[.)])\s+\S")
_FOOTER = re.compile(r"(?:--|—|–)\s+\S|[A-Z][\w-]*(?:\s[\w-]+){0,2}:\s*\S")
_CLOSING = re.compile(r"(?:best|kind|warm)?\s*(?:regards|wishes|thanks|sincerely|cheers)\s*,?$", re.I)
_JOINS = re.compile(r"(?:[,;:/&(\-–]|\b(?:for|and|or|of|the|a|an|to|in|by|with))$")
_UNFINISHED_LINE = re.compile(r"[;(]|\.\s|[!?]\s")


def repair(text: str) -> str:
    """*text* without invisible characters, with entities resolved and the common double encoding undone."""
    if "&" in text:
        text = html.unescape(text)
    if any(c in text for c in "âÃðÂ"):
        # characters of a double encoding, run by run; what is no such run stays
        def undo(m: re.Match) -> str:
            try:
                return m[0].encode("cp1252").decode("utf-8")
            except UnicodeError:
                try:
                    return m[0].encode("latin-1").decode("utf-8")
                except UnicodeError:
                    return m[0]

        text = re.sub("[\u0080-ÿŒœŠšŸŽžƒˆ˜–-›€™]{2,}", undo, text)
    return unicodedata.normalize("NFC", text.translate(INVISIBLE_BUT_JOINER))


INVISIBLE_BUT_JOINER = {k: v for k, v in INVISIBLE.items() if k != 0x200D}


def ending(text: str) -> tuple[str, str]:
    """(kind of ending, last line): one of KINDS, and what phrases are compared by."""
    # a double encoding or an entity can not reach further back than this; code and rows need the whole text
    body = _TAIL.sub("", repair(text))
    lines = [x.rstrip() for x in re.split(r"\r\n|\r|\n", body)]
    last = lines[-1].strip().replace(" ", " ")
    if sum(x.lstrip().startswith("```") for x in lines) % 2:
        return "open_code", last
    if last.startswith("```"):
        return "code", last
    if last.startswith("|"):
        if not last.endswith("|") or len(last) == 1:
            return "open_row", last
        rule = next((x.strip() for x in reversed(lines) if _RULE.fullmatch(x.strip())), None)
        return ("open_row" if rule and rule.count("|") > last.count("|") else "row"), last
    if _DOTS.search(last):
        own_line = len(last) <= 60 and len(last.split()) >= 3 and last[:1].isupper() and not _UNFINISHED_LINE.search(last)
        return ("dots_line" if own_line else "dots_inside"), last
    if _LINK.search(last) and last.endswith("."):
        return "number", last
    if _NUMBER.search(last):
        return "number", last
    if _END.search(last):
        return "sentence", last
    if last.startswith("#"):
        return "heading", last
    if _ITEM.match(last) or (_FOOTER.match(last) and len(last) <= 200 and not re.match(r"[a-z]", last)):
        if _JOINS.search(last):
            return "open_item", last
        if _ITEM.match(last):
            return "item", last
        return ("footer" if _is_footer(lines) else "open_sentence"), last
    if len(lines) > 1 and _CLOSING.search(lines[-2].replace(" ", " ").strip()) and len(last.split()) <= 4:
        return "footer", last
    return "open_sentence", last


def _is_footer(lines: list[str]) -> bool:
    """A last line of the form "Name: some words", after a blank line, or a signature."""
    last = lines[-1].strip()
    if re.match(r"(?:--|—|–)\s", last):
        return len(last.split()) <= 6
    return len(lines) > 1 and not lines[-2].strip() and len(last.split()) <= 16


def endings(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, chars, bytes, kind, last, same): one row per text that is not blank."""
    src = df.select(df[key].alias("key"), F.coalesce(df[source].cast("string"), F.lit("")).alias("source"), df[text].cast("string").alias("text")).where("text IS NOT NULL")
    kind = src.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rows = [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                if t.translate(INVISIBLE).strip():
                    k, last = ending(t)
                    keep.append(i)
                    rows.append((len(t), len(t.encode("utf-8", "surrogatepass")), k, last[-80:] if k == "dots_line" else None))
            at = batch.take(pa.array(keep, pa.int64()))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([at.column(0), at.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)), at.column(3)], ["key", "source", "chars", "bytes", "kind", "last", "same"])

    return src.withColumn("same", F.xxhash64("text")).mapInArrow(run, f"key {kind}, source string, chars bigint, bytes bigint, kind string, last string, same bigint")


_SQRT2, _SQRT2PI = math.sqrt(2.0), math.sqrt(2.0 * math.pi)


def _above(a: float) -> float:
    return max(0.5 * math.erfc(a / _SQRT2), 1e-12)


def fit_limit(x: np.ndarray, n: np.ndarray, limit: int, width: int, rounds: int = 100) -> tuple[float, float, np.ndarray]:
    """(log likelihood, share of longer texts that are cut, chance of a cut at each length in x), by EM.

    x: lengths, n: how many texts have them.  A text longer than *limit* is cut with the share rho and then
    seen in [limit - width, limit], with a chance that falls geometrically below the limit; the log lengths are normal.
    """
    y, total, log_limit = np.log(x), n.sum(), math.log(limit)
    near, over = (x >= limit - width) & (x <= limit), x > limit
    below, longer = np.where(near, limit - x, 0), float(n[over].sum())
    shapes = [f ** np.arange(width + 1) / (f ** np.arange(width + 1)).sum() for f in FALLS] if width else [np.ones(1)]
    shape = shapes[-1]
    mu = float((n * y).sum() / total)
    sd = max(0.05, math.sqrt(float((n * (y - mu) ** 2).sum() / total)))
    rho = 0.5

    def seen() -> tuple[np.ndarray, np.ndarray]:
        """Densities of complete and of cut texts."""
        pdf = np.exp(-0.5 * ((y - mu) / sd) ** 2) / (sd * _SQRT2PI * x)
        return pdf, near * (rho * _above((log_limit - mu) / sd)) * shape[below]

    for _ in range(rounds):
        pdf, cut = seen()
        p = cut / np.maximum(cut + pdf, 1e-300)
        c = float((n * p).sum())
        falls = np.bincount(below[near], (n * p)[near], width + 1)
        shape = max(shapes, key=lambda z: float((falls * np.log(z)).sum()))
        a = (log_limit - mu) / sd
        h = math.exp(-0.5 * a * a) / _SQRT2PI / _above(a)
        first, second = mu + sd * h, mu * mu + sd * sd + sd * h * (log_limit + mu)
        w = n * (1 - p)
        before = mu, sd, rho
        mu = (float((w * y).sum()) + c * first) / total
        sd = math.sqrt(max((float((w * y * y).sum()) + c * second) / total - mu**2, 0.0025))
        rho = min(max((c + 1e-3) / (c + longer + 2e-3), 1e-6), 1 - 1e-6)
        if max(abs(a - b) for a, b in zip(before, (mu, sd, rho), strict=True)) < 1e-5:
            break
    pdf, cut = seen()
    like = np.where(over, (1 - rho) * pdf, pdf + cut)
    return float((n * np.log(np.maximum(like, 1e-300))).sum()), rho, cut / np.maximum(cut + pdf, 1e-300)


def fit_none(x: np.ndarray, n: np.ndarray) -> float:
    y = np.log(x)
    mu = float((n * y).sum() / n.sum())
    sd = max(0.05, math.sqrt(float((n * (y - mu) ** 2).sum() / n.sum())))
    return float((n * (-0.5 * ((y - mu) / sd) ** 2 - np.log(sd * _SQRT2PI * x))).sum())


def candidates(x: np.ndarray, n: np.ndarray, width: int) -> list[int]:
    """Lengths below or at which more texts end, within *width*, than just above and well below."""
    run = np.concatenate(([0.0], np.cumsum(n)))

    def within(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Texts of a length from low to high."""
        return run[np.searchsorted(x, high, side="right")] - run[np.searchsorted(x, low, side="left")]

    at = x[x > max(20, width)]
    here = within(at - width, at)
    reach = 2 * (width + 1) + 20
    low = np.maximum(at - width - reach, 1)
    around = (within(low, at - width - 1) + within(at + 1, at + reach)) / (at - width - low + reach) * (width + 1)
    return [int(v) for v in at[(here >= 4) & (here > 3 * around)]]


LIMITS = "source string, unit string, length bigint, max_size bigint, width int, share_cut double, p double"


def _best_limit(own: dict[str, tuple[np.ndarray, np.ndarray]], taken: list[int]) -> tuple | None:
    """(gain, unit, limit, width, share cut, chances) of the likeliest limit, if one is likelier than none.  A spike that
    stands in both units is one limit: none is sought beside those *taken*."""
    best = None
    for unit, (x, n) in own.items():
        base = fit_none(x, n)
        for width in WIDTHS[unit]:
            for limit in candidates(x, n, width):
                if any(abs(limit - other) <= 2 * max(max(w) for w in WIDTHS.values()) for other in taken):
                    continue
                ll, rho, p = fit_limit(x, n, limit, width)
                # two more parameters, of which the limit was chosen among all lengths and widths
                gain = ll - base - 2 * math.log(n.sum()) - math.log(3 * len(x))
                if gain > 0 and rho >= LEAST_SHARE[bool(taken)] and (best is None or gain > best[0]):
                    best = gain, unit, limit, width, rho, p
    return best


def _limits_of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    own = {}
    for unit in ("chars", "bytes"):
        rows = pdf[(pdf["unit"] == unit) & (pdf["length"] > 0)].sort_values("length")
        if len(rows):
            own[unit] = rows["length"].to_numpy(np.int64), rows["n"].to_numpy(float)
    out, taken = [], []
    while best := _best_limit(own, taken):
        _, unit, limit, width, rho, p = best
        x, n = own[unit]
        near = p > 0
        out.append(pd.DataFrame({"source": key[0], "unit": unit, "length": x[near], "max_size": limit, "width": width, "share_cut": rho, "p": p[near]}))
        # a further limit is sought among the texts that were not cut here
        own[unit] = x, n * (1 - p)
        taken.append(limit)
    return pd.concat(out) if out else pd.DataFrame(columns=["source", "unit", "length", "max_size", "width", "share_cut", "p"])


def limits(found: DataFrame) -> DataFrame:
    """The limits of each source that has any, with the chance of a cut by length.

    Works on the numbers of different texts per source and length, which are as many as there are
    lengths, not texts; equal texts count once, so a text that is delivered often makes no limit.
    """
    once = found.select("source", "same", "chars", "bytes").distinct()
    unit = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))
    counts = once.select("source", unit.alias("u")).groupBy("source", F.col("u.unit").alias("unit"), F.col("u.length").alias("length")).agg(F.count("*").alias("n"))
    return counts.groupBy("source").applyInPandas(_limits_of, LIMITS)


def weights(cut: dict[str, float], away: dict[str, float]) -> tuple[dict[str, float], float, float, float]:
    """(complete texts by kind, cut texts, complete texts, share cut in transfer), from the texts of each kind that were cut at
    a limit and those that were not.

    Of the latter, those cut in transfer end like the former.  As many are taken to be so as have the typical
    ending of each place, which complete texts do not have.
    """
    c = {k: cut.get(k, 0.0) for k in KINDS}
    rest = {k: away.get(k, 0.0) for k in KINDS}
    moved = 0.0
    for kinds in PLACES.values():
        first, all_cut = kinds[0], sum(c[k] for k in kinds)
        share = (c[first] + 1) / (all_cut + 1)
        lost = min(rest[first] / share, sum(rest[k] for k in kinds))
        moved += lost
        for k in kinds:
            rest[k] = max(0.0, rest[k] - lost * (share if k == first else (1 - share) * c[k] / max(all_cut - c[first], 1e-9)))
    total = sum(away.values())
    return rest, sum(c.values()), sum(rest.values()), min(max(moved, SMOOTHING) / max(total, 1.0), 0.5)


def judge(df: DataFrame, key: str, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Returns (judged, limits): judged(key, source, kind, p_length, by_length, by_ending, log_odds, cut), one row per
    text that is neither null, empty nor blank.  log_odds is the sum of what the length and what the ending say; cut
    tells whether it is above 0 and the text ends inside something.  A null source is the source "".
    Rows are judged one by one: repeated keys stay; equal texts get equal results; other columns are ignored.
    A list item or footer whose last words look whole counts as finished.
    """
    found = materialise(endings(df, key, text, source))
    fitted = materialise(limits(found))
    sized = found
    for unit in ("chars", "bytes"):
        chance = fitted.where(F.col("unit") == unit).groupBy("source", F.col("length").alias(unit)).agg(F.max("p").alias(f"p_{unit}"))
        sized = sized.join(chance, ["source", unit], "left")
    sized = sized.withColumn("p_length", F.greatest("p_chars", "p_bytes")).withColumn("p", F.coalesce("p_length", F.lit(0.0)))
    # a text whose last line ends other texts away from limits too: one that is such a text itself needs another
    away = sized.where("kind = 'dots_line' AND p < 0.5").select("last", "same").distinct().groupBy("last").agg(F.count("*").alias("n_away"))
    again = F.coalesce(F.col("n_away"), F.lit(0)) > F.when(F.col("p") < 0.5, 1).otherwise(0)
    kinds = sized.join(away, "last", "left").withColumn("kind", F.when((F.col("kind") == "dots_line") & again, "dots_phrase").otherwise(F.col("kind")))
    # one row per kind: equal texts count once
    each = kinds.groupBy("kind", "same").agg(F.max("p").alias("p")).groupBy("kind").agg(F.sum("p").alias("cut"), F.sum(1 - F.col("p")).alias("away")).collect()
    cut = {r["kind"]: r["cut"] for r in each}
    complete, n_cut, n_complete, transfer = weights(cut, {r["kind"]: r["away"] for r in each})
    number = lambda values: F.create_map(*[x for k in KINDS for x in (F.lit(k), F.lit(float(values.get(k, 0.0))))])[F.col("kind")]
    p, all_ = F.col("p"), SMOOTHING * len(KINDS)
    prior = math.log(transfer / (1 - transfer))
    by_length = F.greatest(F.lit(prior), F.log(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9))))
    # a text is judged by the others: its own share is taken out of its kind
    in_cut = (F.greatest(number(cut) - p, F.lit(0.0)) + SMOOTHING) / (F.lit(n_cut) - p + all_)
    in_complete = (number(complete) + SMOOTHING) / (n_complete + all_)
    judged = kinds.select("key", "source", "kind", "p_length", by_length.alias("by_length"), F.log(in_cut / in_complete).alias("by_ending"))
    judged = judged.withColumn("log_odds", F.col("by_length") + F.col("by_ending"))
    return judged.withColumn("cut", (F.col("log_odds") > 0) & ~F.col("kind").isin(*FINISHED)), fitted
