"""One query per operator over the provided tables, and its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import (
    alignment, compression_quality, conversation_trie, decontaminate, language_crf, packing, pii, quality_rules, secret_scan, simhash,
    suffix_dedup, token_files, url_filter,
)
from runlens.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    text = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", text.alias("fingerprint"), "component_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[f"quality.{f}" for f in fields])


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_scan(table(spark, sf_dir, "documents")))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(language_crf.fold("doc_id", 3) == 1, F.lit(False))
    model = language_crf.fit(docs.where(~held_out))
    return language_crf.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup_passages(table(spark, sf_dir, "documents")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.url_filter(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(language_crf.fold("doc_id", 5) == 0, F.lit(False))
    model = compression_quality.fit(docs, labels.where(~held_out))
    scored = compression_quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.cross_tokenizer_alignment(table(spark, sf_dir, "documents"), TOKENIZER, PIECES)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_files.read_tokens(token_files.write_tokens(table(spark, sf_dir, "documents"), TOKENIZER))
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


QUERIES = {f.__name__: f for f in (
    op1_simhash_dedup, op2_decontaminate, op3_quality_rules, op4_best_fit_packing, op5_secret_scan, op6_personal_data,
    op7_language_id, op8_suffix_dedup, op9_url_filter, op10_quality_classifier, op11_cross_tokenizer_alignment,
    op12_conversation_trie, op13_token_files,
)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_STOPS = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)

ORACLES = {
    "op2_decontaminate": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        items AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
        windows AS (
            SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s
            FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM items)),
        spans AS (
            SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
                  FROM d CROSS JOIN (SELECT DISTINCT n FROM items) WHERE len(w) >= n)),
        hits AS (SELECT doc_id, k, n, item_id FROM spans JOIN windows USING (n, s)),
        words AS (SELECT doc_id, count(*) AS n_hit FROM (
            SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
        own AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
                FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN own USING (doc_id)""",
    "op3_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
        windows AS (SELECT doc_id, k, array_to_string(w[k:k + 7], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d WHERE len(w) >= 8)),
        often AS (SELECT doc_id, s FROM windows GROUP BY doc_id, s HAVING count(*) > 1),
        repeated AS (SELECT doc_id, count(*) AS n FROM (
            SELECT DISTINCT doc_id, unnest(range(k, k + 8)) AS p FROM windows JOIN often USING (doc_id, s)) GROUP BY doc_id),
        c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
                (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
                len(l) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_ex,
                len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha,
                len(list_filter(w, lambda x: trim(lower(x), '.,;:!?"''()') IN ({_STOPS}))) AS n_stop,
                len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_bullet,
                len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis
            FROM d LEFT JOIN repeated USING (doc_id)),
        j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
                greatest(n_words, 1)::DOUBLE AS nw, greatest(n_lines, 1)::DOUBLE AS nl FROM c)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND word_chars / nw BETWEEN 2 AND 14 AND n_symbols / nw <= 0.1 AND n_ex / nw <= 0.2
            AND n_alpha / nw >= 0.6 AND n_stop / nw >= 0.01 AND n_dup_lines / nl <= 0.5 AND n_bullet / nl <= 0.9
            AND n_ellipsis / nl <= 0.5 AS kept
        FROM j""",
}
