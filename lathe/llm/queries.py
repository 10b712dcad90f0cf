"""The operators as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import classlm, fingerprint, packing, piece, quality, simhash, substring, suffix, toxicity, urls
from lathe.llm.common import crc_mod, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), size=20, text=False)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out")
    model = toxicity.fit(docs.where(~held), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, threshold=0.7).select("doc_id", held, "score", "predicted", "n_hits")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), text=False)


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), Path(tokenizer("byte_bpe_50k.json")).read_bytes(), window=2048, end=1)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece.encode_documents(table(spark, sf_dir, "documents"), Path(tokenizer("piece_bpe_32k.model")).read_bytes())


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), size=100, text=False)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = crc_mod(F.col("doc_id"), 5) != 1
    out = classlm.score(docs, learn)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def llm_base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the quality query."""
    return op4_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def llm_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts and rules of the url query, and the verdicts that rules give."""
    return op2_url_filters(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_url_filters": op2_url_filters,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_packing": op5_packing,
    "op6_fingerprints": op6_fingerprints,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_simhash": op9_simhash,
    "op10_lm_scoring": op10_lm_scoring,
    "llm_base_quality": llm_base_quality,
    "llm_url_rules": llm_url_rules,
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, range(20) r(k)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT e.doc_id, count(g.p) AS n_removed, count(*) AS n_words, string_agg(CASE WHEN g.p IS NULL THEN word END, ' ' ORDER BY e.p) AS t FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op8_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
runs AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hit)),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY 1, 2),
ends AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
kept AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS t FROM ends JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "llm_base_quality": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hit, range(5) r(k) GROUP BY 1),
c AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(array_to_string(w, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(list_filter(l, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines FROM d)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(n, 0) > 20 * n_words AS base_failed FROM c LEFT JOIN rep USING (doc_id)""",
    "llm_url_rules": r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT * FROM (VALUES ('com', 'en/', 'block'), ('example.com', 'en/7', 'allow'), ('net', 'de/', 'allow'), ('example.net', 'de/8', 'block'), ('org', 'es/', 'block')) v(h, b, ruled))
SELECT page_id, host, path, h || '/' || b AS rule, ruled FROM q LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, '/' || b)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || b) DESC) = 1""",
}
