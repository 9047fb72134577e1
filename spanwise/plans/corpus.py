"""Queries on documents and chunks: cutting, tokens, ids, manifests, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import table
from ..functions import spans as S
from ..functions import text as T
from ..operators import chunking as C
from ..operators import model as M
from ..operators import validate as V

#: White space as the JVM's Unicode classes have it, for SQL engines whose \s is ASCII.
WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '{T.TOKEN}'), lambda x: x NOT IN ({STOP}))"


def words_sql(text: str) -> str:
    return f"len(list_filter(string_split_regex({text}, '{WS}+'), lambda x: x <> ''))"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return M.documents(table(spark, d, "corpus_docs"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return M.chunks(table(spark, d, "chunks"))


def chunk_fixed_size(spark: SparkSession, d: str) -> DataFrame:
    return C.fixed_size(_docs(spark, d)).select("chunk_id", "doc_id", "char_start", "char_end", "token_count")


def chunk_markdown(spark: SparkSession, d: str) -> DataFrame:
    return C.markdown(_docs(spark, d)).drop("text")


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per language of `documents`: texts, windows of 500/50, their mean length."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.lower("lang"), F.lit("?")).alias("lang"), F.col("text").alias("body"))
    cut = C.fixed_size(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("char_end") - F.col("char_start")).alias("chars"))
    return docs.select("doc_id", "lang").join(cut, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), F.round(F.sum("chars") / F.sum("n"), 6).alias("mean_chars"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.word_count("text").alias("n_words"), T.approx_tokens("text").alias("n_tokens"))


def document_frequencies(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "documents").select("doc_id", F.explode_outer(F.array_distinct(T.tokenize("text"))).alias("term")).where("term IS NOT NULL")
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def corpus_manifest(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.coalesce(F.length("body"), F.lit(0)).alias("n_chars"), F.sha2("body", 256).alias("sha256"), "version", (F.col("superseded_by").isNotNull() | (F.lower("status") == "superseded")).alias("superseded"))


def corpus_manifest_hash(spark: SparkSession, d: str) -> DataFrame:
    """One hash over the (doc_id, hash) pairs: of the 4096 hashes of the sorted pairs of each id prefix, so
    that no task holds the list of all documents."""
    pairs = _docs(spark, d).select(F.substring(F.sha2("doc_id", 256), 1, 3).alias("b"), F.concat_ws(":", "doc_id", F.coalesce("sha256", F.lit(""))).alias("p"))
    parts = pairs.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("p")), "\n"), 256).alias("h"), F.count("*").alias("n"))
    return parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "b", "h"))), "\n"), 256).alias("manifest_sha"), F.sum("n").alias("n_docs"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    docs, chunks = _docs(spark, d), _chunks(spark, d)
    words = docs.where("body IS NOT NULL").agg(F.sum(T.word_count("body")).alias("n"))
    one = lambda what, df, c: df.select(F.lit(what).alias("what"), F.coalesce(c, F.lit(0)).cast("bigint").alias("n"))
    return one("documents", docs.agg(F.count("*").alias("n")), F.col("n")).unionByName(one("chunks", chunks.agg(F.count("*").alias("n")), F.col("n"))).unionByName(one("words", words, F.col("n")))


def authoritative_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts that more than one document claims to own."""
    facts = _docs(spark, d).select("doc_id", F.explode(F.array_distinct("authoritative_for")).alias("fact_id"))
    return facts.groupBy("fact_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).where("n_docs > 1")


def validate_front_matter(spark: SparkSession, d: str) -> DataFrame:
    return V.front_matter(_docs(spark, d))


def validate_superseded(spark: SparkSession, d: str) -> DataFrame:
    """Links between versions that lead to no document, or to one that does not point back."""
    docs = _docs(spark, d).select("doc_id", "supersedes", "superseded_by")
    other = docs.select(F.col("doc_id").alias("supersedes"), F.col("superseded_by").alias("back"))
    return docs.where("supersedes IS NOT NULL").join(other.withColumn("there", F.lit(True)), "supersedes", "left").where("there IS NULL OR back IS NULL OR back <> doc_id").select("doc_id", "supersedes", F.coalesce("there", F.lit(False)).alias("exists"))


def validate_checksums(spark: SparkSession, d: str) -> DataFrame:
    return V.checksums(_docs(spark, d).select(F.col("doc_id").alias("path"), F.col("sha256").alias("recorded")), _docs(spark, d).where("body IS NOT NULL").select(F.col("doc_id").alias("path"), F.sha2("body", 256).alias("actual")))


def validate_encoding(spark: SparkSession, d: str) -> DataFrame:
    return V.encoding(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def validate_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose id is not that of their document and text, and chunks that are not what stands at their place."""
    chunks = _chunks(spark, d)
    bodies = _docs(spark, d).select("doc_id", "body")
    both = chunks.join(bodies, "doc_id", "left")
    at_place = F.expr("substring(body, char_start + 1, char_end - char_start)") == F.col("text")
    return both.select("chunk_id", (T.content_id("doc_id", "text") == F.col("chunk_id")).alias("id_ok"), F.coalesce(at_place, F.lit(False)).alias("place_ok")).where("NOT id_ok OR NOT place_ok")


def validate_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Probe terms that must be nowhere, with the documents that mention them as words."""
    return V.gap_probes(_docs(spark, d).select("doc_id", "body"), {"refunds": ["refunded", "chargeback ledger"], "voice": ["biometric", "voice print"], "tax": ["withholding"]})


def latest_versions(spark: SparkSession, d: str) -> DataFrame:
    """The last document of each chain of versions (those that nothing supersedes), by owner."""
    docs = _docs(spark, d)
    last = docs.join(docs.select(F.col("supersedes").alias("doc_id")).where("doc_id IS NOT NULL").distinct(), "doc_id", "left_anti")
    return last.groupBy(F.coalesce("owner", F.lit("?")).alias("owner")).agg(F.count("*").alias("n_docs"), F.max("effective_date").alias("newest"))


def quote_places(spark: SparkSession, d: str) -> DataFrame:
    """Where each evidence quote stands verbatim in its document: -1 where it does not."""
    spans = M.spans(table(spark, d, "evidence_spans")).where("length(quote) > 0").select("span_row_id", "doc_id", "quote")
    return spans.join(_docs(spark, d).select("doc_id", "body"), "doc_id").select("span_row_id", F.coalesce(S.find_exact(F.col("body"), F.col("quote")), F.lit(-1)).cast("int").alias("found_at"))


def quote_places_flexible(spark: SparkSession, d: str) -> DataFrame:
    """The same up to white space and normal form."""
    spans = M.spans(table(spark, d, "evidence_spans")).where("length(quote) > 0").select("span_row_id", "doc_id", "quote")
    both = spans.join(_docs(spark, d).select("doc_id", "body"), "doc_id")
    return both.select("span_row_id", S.resolve_quote("body", "quote").alias("at")).select("span_row_id", "at.char_start", "at.char_end")


def chunk_heading_depth(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and their mean tokens by depth of the heading path (0 for none)."""
    depth = F.coalesce(F.size("heading_path"), F.lit(0))
    chunks = _chunks(spark, d).withColumn("depth", F.when(F.col("heading_path").isNull(), 0).otherwise(depth))
    return chunks.groupBy("depth").agg(F.count("*").alias("n_chunks"), F.round(F.avg(T.approx_tokens("text")), 6).alias("mean_tokens"))


def chunk_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Per document, neighbouring chunks (by place) that share characters, and how many."""
    w = W.partitionBy("doc_id").orderBy("char_start", "char_end", "chunk_id")
    shared = S.overlap_length(F.col("char_start"), F.col("char_end"), F.lag("char_start").over(w), F.lag("char_end").over(w))
    return _chunks(spark, d).select("doc_id", F.when(F.lag("char_end").over(w).isNotNull(), shared).alias("shared")).groupBy("doc_id").agg(F.count(F.when(F.col("shared") > 0, 1)).alias("n_overlaps"), F.coalesce(F.sum("shared"), F.lit(0)).alias("n_chars")).where("n_overlaps > 0")


QUERIES = {
    f.__name__: f
    for f in (
        chunk_fixed_size, chunk_markdown, chunk_stats, token_counts, document_frequencies, corpus_manifest, corpus_manifest_hash, corpus_stats, authoritative_facts, validate_front_matter, validate_superseded,
        validate_checksums, validate_encoding, validate_chunk_ids, validate_gaps, latest_versions, quote_places, quote_places_flexible, chunk_heading_depth, chunk_overlaps,
    )
}

_CUT = "SELECT {keys}, body, length(body) AS n, unnest(generate_series(0, greatest(0, ceil((length(body) - 500) / 450.0))::BIGINT)) * 450 AS char_start FROM {src} WHERE body IS NOT NULL"
_TOKENS = "(floor(" + words_sql("text") + " * 1.3::DOUBLE) + 1)::INTEGER"

ORACLES = {
    "chunk_fixed_size": f"""
{M.with_("do")}, cut AS ({_CUT.format(keys="doc_id", src="d")}),
p AS (SELECT doc_id, char_start::INTEGER AS char_start, least(char_start + 500, n)::INTEGER AS char_end, substring(body, char_start + 1, 500) AS text FROM cut)
SELECT doc_id || '#' || substring(sha1(text), 1, 8) AS chunk_id, doc_id, char_start, char_end, {_TOKENS} AS token_count FROM p WHERE NOT regexp_full_match(text, '{WS}*')
""",
    "chunk_stats": f"""
WITH s AS (SELECT doc_id, coalesce(lower(lang), '?') AS lang, text AS body FROM documents), cut AS ({_CUT.format(keys="doc_id", src="s")}),
p AS (SELECT doc_id, count(*) AS n, sum(least(char_start + 500, n) - char_start) AS chars FROM cut WHERE NOT regexp_full_match(substring(body, char_start + 1, 500), '{WS}*') GROUP BY doc_id)
SELECT lang, count(*) AS n_docs, coalesce(sum(n), 0)::BIGINT AS n_chunks, round(sum(chars)::DOUBLE / sum(n), 6) AS mean_chars FROM s LEFT JOIN p USING (doc_id) GROUP BY lang
""",
    "token_counts": f"SELECT doc_id, {words_sql('text')}::INTEGER AS n_words, {_TOKENS} AS n_tokens FROM documents WHERE text IS NOT NULL",
    "document_frequencies": f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({tokens_sql('text')})) AS term FROM documents) GROUP BY term",
    "corpus_manifest": f"{M.with_('do')} SELECT doc_id, coalesce(length(body), 0)::INTEGER AS n_chars, sha256(body) AS sha256, version, (superseded_by IS NOT NULL OR lower(status) = 'superseded') AS superseded FROM d",
    "corpus_manifest_hash": f"""
{M.with_("do")}, p AS (SELECT substring(sha256(doc_id), 1, 3) AS b, doc_id || ':' || coalesce(sha256, '') AS p FROM d),
g AS (SELECT b, sha256(string_agg(p, chr(10) ORDER BY p)) AS h, count(*) AS n FROM p GROUP BY b)
SELECT sha256(string_agg(b || ':' || h, chr(10) ORDER BY b || ':' || h)) AS manifest_sha, sum(n)::BIGINT AS n_docs FROM g
""",
    "corpus_stats": f"""
{M.with_("do", "ch")} SELECT 'documents' AS what, count(*) AS n FROM d UNION ALL SELECT 'chunks', count(*) FROM ch
UNION ALL SELECT 'words', coalesce(sum({words_sql("body")}), 0)::BIGINT FROM d WHERE body IS NOT NULL
""",
    "authoritative_facts": f"{M.with_('do')} SELECT fact_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM (SELECT doc_id, unnest(list_distinct(authoritative_for)) AS fact_id FROM d) WHERE fact_id IS NOT NULL GROUP BY fact_id HAVING count(*) > 1",
    "validate_front_matter": f"""
{M.with_("do")}, m AS (SELECT doc_id, list_filter([CASE WHEN doc_id IS NULL THEN 'doc_id' END, CASE WHEN title IS NULL THEN 'title' END, CASE WHEN version IS NULL THEN 'version' END, CASE WHEN effective_date IS NULL THEN 'effective_date' END], lambda x: x IS NOT NULL) AS missing, synthetic IS DISTINCT FROM true AS not_synthetic, coalesce(trim(disclaimer), '') = '' AS no_disclaimer FROM d)
SELECT doc_id, array_to_string(missing, ',') AS missing, not_synthetic, no_disclaimer FROM m WHERE len(missing) > 0 OR not_synthetic OR no_disclaimer
""",
    "validate_superseded": f"{M.with_('do')} SELECT a.doc_id, a.supersedes, b.doc_id IS NOT NULL AS exists FROM d a LEFT JOIN d b ON b.doc_id = a.supersedes WHERE a.supersedes IS NOT NULL AND (b.doc_id IS NULL OR b.superseded_by IS NULL OR b.superseded_by <> a.doc_id)",
    "validate_checksums": f"{M.with_('do')} SELECT doc_id AS path, CASE WHEN body IS NULL THEN 'MISSING' ELSE 'CHANGED' END AS problem FROM d WHERE sha256 IS NOT NULL AND (body IS NULL OR sha256(body) <> sha256)",
    "validate_encoding": "SELECT doc_id, starts_with(text, chr(65279)) AS has_bom, (contains(text, 'â€') OR contains(text, 'Ã©') OR contains(text, 'Â ')) AS has_mojibake, contains(text, chr(65533)) AS has_replacement FROM documents WHERE starts_with(text, chr(65279)) OR contains(text, 'â€') OR contains(text, 'Ã©') OR contains(text, 'Â ') OR contains(text, chr(65533))",
    "validate_chunk_ids": f"""
{M.with_("ch", "do")}, c AS (SELECT chunk_id, doc_id || '#' || substring(sha1(text), 1, 8) = chunk_id AS id_ok, coalesce(substring(body, char_start + 1, char_end - char_start) = text, false) AS place_ok FROM ch LEFT JOIN (SELECT doc_id, body FROM d) USING (doc_id))
SELECT * FROM c WHERE NOT id_ok OR NOT place_ok
""",
    "validate_gaps": f"""
{M.with_("do")}, g AS (SELECT * FROM (VALUES ('refunds', 'refunded'), ('refunds', 'chargeback ledger'), ('voice', 'biometric'), ('voice', 'voice print'), ('tax', 'withholding')) t(gap_id, term))
SELECT gap_id, term, doc_id FROM g JOIN d ON regexp_matches(body, '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])' || term || '($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])')
""",
    "latest_versions": f"{M.with_('do')} SELECT coalesce(owner, '?') AS owner, count(*) AS n_docs, max(effective_date) AS newest FROM d WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.supersedes = d.doc_id) GROUP BY 1",
    "quote_places_flexible": f"""{M.with_("sp", "do")},
q AS (SELECT span_row_id, nfc_normalize(body) AS b, nfc_normalize(quote) AS q FROM sp JOIN (SELECT doc_id, body FROM d) USING (doc_id) WHERE length(quote) > 0),
w AS (SELECT *, list_filter(string_split_regex(q, '{WS}+'), lambda x: x <> '') AS ws FROM q),
m AS (SELECT span_row_id, b, CASE WHEN len(ws) = 0 OR coalesce(b, '') = '' THEN '' WHEN contains(b, q) THEN q ELSE regexp_extract(b, array_to_string(list_transform(ws, lambda x: regexp_escape(x)), '{WS}+')) END AS m FROM w)
SELECT span_row_id, CASE WHEN coalesce(m, '') = '' THEN -1 ELSE strpos(b, m) - 1 END::INTEGER AS char_start, CASE WHEN coalesce(m, '') = '' THEN -1 ELSE strpos(b, m) - 1 + length(m) END::INTEGER AS char_end FROM m""",
    "quote_places": f"{M.with_('sp', 'do')} SELECT span_row_id, coalesce(strpos(body, quote) - 1, -1)::INTEGER AS found_at FROM sp JOIN (SELECT doc_id, body FROM d) USING (doc_id) WHERE length(quote) > 0",
    "chunk_heading_depth": f"{M.with_('ch')} SELECT coalesce(len(heading_path), 0)::INTEGER AS depth, count(*) AS n_chunks, round(avg({_TOKENS}), 6) AS mean_tokens FROM ch GROUP BY 1",
    "chunk_overlaps": f"""
{M.with_("ch")}, o AS (SELECT doc_id, greatest(0, least(char_end, lag(char_end) OVER w) - greatest(char_start, lag(char_start) OVER w)) * (lag(char_end) OVER w IS NOT NULL)::INT AS shared FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY char_start, char_end, chunk_id))
SELECT doc_id, count(*) FILTER (shared > 0) AS n_overlaps, sum(shared)::BIGINT AS n_chars FROM o GROUP BY doc_id HAVING count(*) FILTER (shared > 0) > 0
""",
}
