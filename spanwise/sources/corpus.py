"""Markdown documents with YAML front matter, and the fact ledger that describes them."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorpusError

DOCUMENT = (
    "path string, doc_id string, title string, body string, version string, effective_date string, status string, supersedes string, "
    "superseded_by string, owner string, synthetic boolean, disclaimer string, authoritative_for array<string>, sha256 string, problem string"
)
#: Front matter and body; fixed value.
_PARTS = re.compile(r"\A---\n(.*?)\n---\n(.*)\Z", re.DOTALL)
_TEXTS = ("title", "version", "effective_date", "status", "supersedes", "superseded_by", "owner", "disclaimer")


def parse_document(path: str, content: bytes) -> dict:
    """A file as a row; *problem* says what is wrong with it, the other columns are then empty."""
    import yaml

    row: dict = {"path": path, "problem": None}
    try:
        if content.startswith(b"\xef\xbb\xbf"):
            raise ValueError("byte order mark")
        parts = _PARTS.match(content.decode("utf-8").replace("\r\n", "\n"))
        if not parts:
            raise ValueError("no front matter")
        front = yaml.safe_load(parts[1]) or {}
        body = unicodedata.normalize("NFC", parts[2])
        row |= {k: None if front.get(k) is None else str(front[k]) for k in _TEXTS}
        row |= {"doc_id": str(front.get("doc_id") or Path(path).stem), "body": body, "synthetic": front.get("synthetic") if isinstance(front.get("synthetic"), bool) else None}
        owned = front.get("authoritative_for") or []
        row |= {"authoritative_for": [str(x) for x in owned], "sha256": hashlib.sha256(body.encode()).hexdigest()}
    except (ValueError, yaml.YAMLError) as e:
        row["problem"] = str(e)[:200]
    return row


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per ``*.md`` in *folder*, problems included; files are parsed where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder).select("path", "content")
    names = [c.split()[0] for c in DOCUMENT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [dict.fromkeys(names) | parse_document(p, bytes(c)) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return files.mapInPandas(run, DOCUMENT)


def load_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The documents in *folder*; an empty folder, an unreadable file or two files with one doc_id raise CorpusError."""
    docs = read_documents(spark, folder)
    bad = docs.where("problem IS NOT NULL").select("path", "problem").take(5)
    if bad:
        raise CorpusError("; ".join(f"{r['path']}: {r['problem']}" for r in bad))
    twice = docs.groupBy("doc_id").count().where("count > 1").take(5)
    if twice:
        raise CorpusError(f"documents with one id: {[r['doc_id'] for r in twice]}")
    if docs.isEmpty():
        raise CorpusError(f"no documents in {folder}")
    return docs.drop("problem", "path")


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, sha256, n_chars, version, superseded) of each document."""
    return docs.select("doc_id", "sha256", F.length("body").alias("n_chars"), "version", F.col("superseded_by").isNotNull().alias("superseded"))


def load_ledger(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The fact ledger as four tables: facts, superseded, chains (one row per hop), gaps."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text("utf-8")) or {}
    text = lambda x: None if x is None else str(x)
    many = lambda x: [str(v) for v in x or []]
    facts = [(text(f["id"]), text(f["value"]), text(f.get("unit")), text(f["authoritative_doc"]), many(f.get("restated_in")), many(f.get("aliases")), many(f.get("value_components")), many(f.get("distractor_for")), text(f.get("ambiguity_group"))) for f in raw.get("facts") or []]
    old = [(text(s["id"]), side, text(s[side]["value"]), text(s[side]["doc"])) for s in raw.get("superseded") or [] for side in ("current", "previous")]
    hops = [(text(c["id"]), i, text(h.get("fact")), text(h.get("doc"))) for c in raw.get("multihop_chains") or [] for i, h in enumerate(c.get("hops") or [])]
    gaps = [(text(g["id"]), text(g.get("topic")), many(g.get("probe_terms"))) for g in raw.get("gaps") or []]
    return {
        "facts": spark.createDataFrame(facts, "id string, value string, unit string, authoritative_doc string, restated_in array<string>, aliases array<string>, value_components array<string>, distractor_for array<string>, ambiguity_group string"),
        "superseded": spark.createDataFrame(old, "id string, side string, value string, doc_id string"),
        "chains": spark.createDataFrame(hops, "id string, hop int, fact_id string, doc_id string"),
        "gaps": spark.createDataFrame(gaps, "id string, topic string, probe_terms array<string>"),
    }


#: A line of a checksum list: 64 hex digits, two blanks, a path.  Fixed value.
CHECKSUM = r"^([0-9a-f]{64})\s\s(\S+)$"


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, recorded) of the checksum lines in a text file; other lines are passed over."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where(F.col("value").rlike(CHECKSUM))
    return lines.select(F.regexp_extract("value", CHECKSUM, 2).alias("path"), F.regexp_extract("value", CHECKSUM, 1).alias("recorded"))


def file_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(path, actual) of every file below *folder*, hashed where it is read; paths are relative to it."""
    base = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    relative = F.regexp_replace("path", "^(file:)?/*" + re.escape(base.lstrip("/")) + "/", "")
    return files.select(relative.alias("path"), F.sha2("content", 256).alias("actual"))


def check_encoding(spark: SparkSession, folder: str) -> DataFrame:
    """(path, problem): files that begin with a byte order mark, are not UTF-8, or show traces of double encoding."""
    from ..operators.validate import MOJIBAKE

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    twice = F.lit(False)
    for m in MOJIBAKE:
        twice = twice | F.contains(text, F.lit(m))
    mark = F.hex(F.substring("content", 1, 3)) == "EFBBBF"
    return files.select("path", F.when(mark, "byte order mark").when(text.isNull(), "not UTF-8").when(twice, "double encoding").alias("problem")).where("problem IS NOT NULL")
