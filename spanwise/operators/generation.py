"""Prompts, and answers from a table: no model is called here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError

RESPONSES = "prompt_hash string, text string, prompt_tokens bigint, completion_tokens bigint, latency_ms double, model string"


def pack_context(ranked: DataFrame, group: list[str]) -> DataFrame:
    """(group..., context_text, context_labels): excerpts in rank order, labelled C1, C2..., each with its
    document and headings, and the map from label to chunk.  ranked(group..., rank, chunk_id, doc_id, heading_path, text)."""
    head = F.when(F.size("heading_path") > 0, F.array_join("heading_path", " > ")).otherwise(F.col("doc_id"))
    row = F.struct("rank", "chunk_id", "doc_id", head.alias("head"), F.regexp_replace("text", r"^(?U)\s+|(?U)\s+$", "").alias("text"))
    lists = ranked.groupBy(*group).agg(F.array_sort(F.collect_list(row)).alias("xs"))
    label = lambda i: F.concat(F.lit("C"), (i + 1).cast("string"))
    part = F.transform("xs", lambda x, i: F.concat(F.lit("["), label(i), F.lit("] ("), x["doc_id"], F.lit(" :: "), x["head"], F.lit(")\n"), x["text"]))
    labels = F.map_from_entries(F.transform("xs", lambda x, i: F.struct(label(i).alias("key"), x["chunk_id"].alias("value"))))
    return lists.select(*group, F.array_join(part, "\n\n").alias("context_text"), labels.alias("context_labels"))


def render_prompt(template: str, context: Column, question: Column) -> Column:
    """The template with ``{{ context }}`` and ``{{ question }}`` filled in, once each and in this order of the text."""
    out, rest = F.lit(""), template
    while rest:
        places = sorted((rest.find(k), k, v) for k, v in (("{{ context }}", context), ("{{ question }}", question)) if k in rest)
        if not places:
            return F.concat(out, F.lit(rest))
        at, key, value = places[0]
        out, rest = F.concat(out, F.lit(rest[:at]), F.coalesce(value, F.lit(""))), rest[at + len(key) :]
    return out


def answer(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """prompts(..., prompt) with the stored answer of each prompt's SHA-256.  A prompt without one is an
    error of its row, never a default; the rows stay."""
    keyed = prompts.withColumn("prompt_hash", F.sha2("prompt", 256))
    out = keyed.join(responses.withColumnRenamed("text", "answer"), "prompt_hash", "left")
    missing = F.concat(F.lit("no stored answer for prompt "), F.substring("prompt_hash", 1, 12))
    return out.withColumn("errors", F.when(F.col("answer").isNull(), F.array(missing)).otherwise(F.array().cast("array<string>")))


def build_generator(kind: str, responses: DataFrame | None):
    """prompts -> answers of a configuration; only stored answers are offered."""
    if kind not in ("scripted", "cached") or responses is None:
        raise ConfigError(f"unknown or unavailable generator: {kind!r}")
    return lambda prompts: answer(prompts, responses)
