"""Text functions as Column expressions; Arrow UDFs only where a function is sequential."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

# --- fixed values: they must equal those of the published evaluation protocol ---
TOKEN = r"\$?[a-z0-9_]+(?:[.\-+/][a-z0-9_]+)*%?"
STOPWORDS = "a an the of to in for on at by is are was were be been it its this that as with from or and if then than which what when how".split()
CITATION = r"(?i)\[(C\d+(?:\s*,\s*C\d+)*)\]"
LABEL = r"(?i)C\d+"
NUMBER = r"(?U)(?<![\w.])(\d[\d,]*(?:\.\d+)?)"
FULL_WIDTH = "０１２３４５６７８９"
CLAIM_TOKEN = r"\$?\d[\d,]*(?:\.\d+)?%?|[A-Z]{2,}_\d+|T\+\d+"
CLARIFICATION = ["which plan", "which region", "could you clarify", "can you clarify", "do you mean", "did you mean", "depends on", "it depends", "which did you mean", "are you asking"]
SOURCE = r"(?:the\s+)?(?:documentation|excerpts?|context|sources?|passages?|documents?|text|information\s+provided|provided\s+\w+)"
NEGATION = r"(?:do(?:es)?\s+not|don't|doesn't|fail\s+to|fails\s+to)"
REPORT = r"(?:contain|include|state|specify|mention|say|answer|cover|provide|address|indicate|detail)"
ABSTENTION = "|".join(
    [
        rf"\b{SOURCE}\s+(?:\w+\s+){{0,3}}{NEGATION}\s+(?:\w+\s+){{0,3}}{REPORT}\b",
        rf"\b{NEGATION}\s+(?:appear\s+)?(?:to\s+be\s+)?{REPORT}(?:ed)?\s+(?:\w+\s+){{0,2}}(?:in|by)\s+{SOURCE}\b",
        r"\b(?:cannot|can't|unable\s+to)\s+(?:answer|determine|find|verify)\b",
        r"\b(?:no|insufficient)\s+information\b",
        r"\bi\s+(?:don't|do\s+not)\s+know\b",
        r"\bnot\s+(?:documented|specified|stated|mentioned|covered)\b",
        rf"\bis\s+not\s+(?:in|present\s+in|found\s+in|available\s+in)\s+{SOURCE}\b",
    ]
)
ABBREVIATIONS = ["No.", "e.g.", "i.e.", "vs.", "approx.", "Inc.", "Ltd.", "cf."]
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z0-9$])"
BULLET = r"\s*(?:[-*•]|\d+[.)])\s+"
# --- end of fixed values ---


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text: Column | str) -> Column:
    """Lower-case tokens that keep amounts, percentages and codes whole, without stop words.  Null for null."""
    tokens = F.regexp_extract_all(F.lower(_c(text)), F.lit(f"({TOKEN})"), F.lit(1))
    return F.filter(tokens, lambda t: ~t.isin(STOPWORDS))


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(_c(text), r"(?U)\s+"), lambda w: w != ""))


def approx_tokens(text: Column | str) -> Column:
    """Estimate: 1.3 tokens a word, rounded down, and one."""
    return (F.floor(word_count(text) * F.lit(1.3)) + 1).cast("int")


def content_id(doc_id: Column | str, text: Column | str) -> Column:
    """doc_id#first eight hex digits of the text's SHA-1: equal texts of a document share an id."""
    return F.concat(_c(doc_id), F.lit("#"), F.substring(F.sha1(F.encode(_c(text), "UTF-8")), 1, 8))


def extract_labels(text: Column | str) -> Column:
    """Citation labels in order of first appearance, upper-case."""
    groups = F.regexp_extract_all(_c(text), F.lit(CITATION), F.lit(1))
    labels = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(f"({LABEL})"), F.lit(1))))
    return F.array_distinct(F.transform(labels, F.upper))


def strip_labels(text: Column | str) -> Column:
    """Without citation groups, blanks before punctuation, and runs of white space."""
    bare = F.regexp_replace(_c(text), CITATION, "")
    bare = F.regexp_replace(bare, r"(?U)\s+([.,;:!?)])", "$1")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def numbers_in(text: Column | str) -> Column:
    """Numbers as doubles: thousands separators removed; digits that follow a letter, digit or point are none.
    Full-width digits are digits."""
    raw = F.regexp_extract_all(F.translate(_c(text), FULL_WIDTH, "0123456789"), F.lit(NUMBER), F.lit(1))
    return F.filter(F.transform(raw, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")), lambda x: x.isNotNull())


def claim_token(claim: Column | str) -> Column:
    """The first amount, code or date offset in a claim, lower-case; null if there is none."""
    return F.lower(F.get(F.regexp_extract_all(_c(claim), F.lit(f"({CLAIM_TOKEN})"), F.lit(1)), F.lit(0)))


def detect_abstention(answer: Column | str) -> Column:
    """Whether the answer says that the sources do not tell.  Null for null."""
    return strip_labels(answer).rlike(f"(?iU)(?:{ABSTENTION})")


def detect_clarification(answer: Column | str) -> Column:
    """Whether the answer turns on a condition: two cues, or one and a question mark."""
    text = F.lower(strip_labels(answer))
    hits = sum((F.when(F.contains(text, F.lit(m)), 1).otherwise(0) for m in CLARIFICATION), F.lit(0))
    return F.when(_c(answer).isNotNull(), (hits >= 2) | ((hits >= 1) & F.contains(_c(answer), F.lit("?"))))


def observed_behaviour(abstained: Column, clarified: Column) -> Column:
    return F.when(abstained, "abstain").when(clarified, "clarify").otherwise("answer")


def plain(text: Column | str) -> Column:
    """For fact checks: Markdown emphasis, code marks and table bars as blanks, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(text), r"[*_`|]", " "), r"(?U)\s+", " "))


def contains_fact(body: Column, value: Column, aliases: Column, components: Column) -> Column:
    """All components where there are any, else the value or any alias; compared in plain form."""
    text = plain(body)
    has = lambda x: F.contains(text, plain(x))
    return F.when(F.size(F.coalesce(components, F.array())) > 0, F.forall(components, has)).otherwise(has(value) | F.coalesce(F.exists(aliases, has), F.lit(False)))


def mentions(body: Column, term: Column) -> Column:
    """Whether *term* occurs as whole words, whatever its case."""
    return F.rlike(body, F.concat(F.lit(r"(?iU)\b\Q"), term, F.lit(r"\E\b")))


@F.pandas_udf(ST.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C.  Spark has no such function."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t), na_action="ignore")


_GUARD = "".join(rf"(?<!\b{re.escape(a)})" for a in ABBREVIATIONS)
_SENTENCE = re.compile(_GUARD + SENTENCE_GAP)
_BULLET = re.compile(BULLET)
_LABELS = re.compile(CITATION)
CLAIM = ST.ArrayType(
    ST.StructType(
        [
            ST.StructField("claim_id", ST.StringType()),
            ST.StructField("text", ST.StringType()),
            ST.StructField("char_start", ST.IntegerType()),
            ST.StructField("char_end", ST.IntegerType()),
            ST.StructField("cited_labels", ST.ArrayType(ST.StringType())),
        ]
    )
)


def claims_of(answer: str) -> list[dict]:
    """Lines of an answer as claims: a bullet is one, other lines are cut at sentence ends.

    char_start and char_end are code points of *answer*, and answer[start:end] is the text.
    """
    out: list[dict] = []
    for line in re.finditer(r"[^\n]+", answer):
        text, base = line[0], line.start()
        if _BULLET.match(text):
            cuts = [(0, len(text))]
        else:
            ends = [(m.start(), m.end()) for m in _SENTENCE.finditer(text)]
            cuts = list(zip([0, *(e for _, e in ends)], [*(s for s, _ in ends), len(text)], strict=True))
        for a, z in cuts:
            piece = text[a:z].strip()
            if piece:
                start = base + a + len(text[a:z]) - len(text[a:z].lstrip())
                labels = dict.fromkeys(x.upper() for g in _LABELS.findall(piece) for x in re.findall(r"C\d+", g, re.I))
                out.append({"claim_id": f"cl{len(out)}", "text": piece, "char_start": start, "char_end": start + len(piece), "cited_labels": list(labels)})
    return out


@F.pandas_udf(CLAIM)
def split_claims(answer: pd.Series) -> pd.Series:
    """Claims of each answer; an empty list for an empty answer, null for null."""
    return answer.map(claims_of, na_action="ignore")
