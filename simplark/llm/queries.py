"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplark.llm import decontaminate, exact_dedup, language_id, licenses, lm_score, resample, sentencepiece, sharding, simhash, spelling, token_ids, toxicity, warc
from simplark.llm.common import fold, new_folder, table


def tokenizer(name: str) -> str:
    """The path of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece.encode(docs, tokenizer("piece_bpe_32k.model"), keep=["doc_id"])


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return toxicity.predict(docs.select("doc_id", held_out, "text"), model, ["doc_id", "held_out"])


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 1, F.lit(False))
    return lm_score.score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) != 1, held_out)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.round_trip(table(spark, sf_dir, "documents"), new_folder(spark, "token-ids"), tokenizer("byte_bpe_50k.json"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16, law="bytes", map_path=new_folder(spark, "slot-map"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, language_id.learnable())
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return language_id.predict(docs.select("doc_id", held_out, "text"), model, ["doc_id", "held_out"])


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling(table(spark, sf_dir, "documents"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_lm_score": op4_lm_score,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_ids": op7_token_ids,
    "op8_sharding": op8_sharding,
    "op9_simhash": op9_simhash,
    "op10_language_id": op10_language_id,
    "op11_spelling": op11_spelling,
    "op12_licenses": op12_licenses,
    "op13_resample": op13_resample,
}

def license_sql() -> str:
    """All blocks and all templates, without filters; places of phrases word by word."""
    rows = ", ".join(
        f"({i}, '{label}', {str(phrase).lower()}, {needed}, [{', '.join(repr(w.decode()) for w in words)}])"
        for i, (label, words, phrase, needed) in enumerate(licenses.templates())
    )
    return f"""
        WITH t(tid, label, phrase, needed, words) AS (VALUES {rows}),
        d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
        ), x AS (
            SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d
        ), tokens AS (
            SELECT tid, len(words) AS step, unnest(list_distinct(words)) AS w FROM t WHERE NOT phrase
        ), b AS (
            SELECT r, tid, w, i // step AS block FROM x JOIN tokens USING (w)
            UNION ALL
            SELECT r, tid, w, i // step - 1 FROM x JOIN tokens USING (w) WHERE i >= step
        ), met AS (
            SELECT r, label, count(DISTINCT w) AS shared, any_value(needed) AS needed, any_value(len(list_distinct(words))) AS m
            FROM b JOIN t USING (tid) GROUP BY r, tid, label, block
        ), notices AS (
            SELECT r, label, max(shared / m) AS share FROM met WHERE shared >= needed GROUP BY r, label
        ), places AS (
            SELECT r, label, i FROM x JOIN t ON t.phrase AND x.w = t.words[1] JOIN d USING (r) WHERE d.ws[i + 1:i + len(t.words)] = t.words
        ), base AS (
            SELECT r, count(*) AS n, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r
        ), every AS (
            SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
            FROM (SELECT r, label, share FROM notices UNION ALL SELECT r, label, 1.0 FROM places) GROUP BY r
        )
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
            coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
        FROM d LEFT JOIN base USING (r) LEFT JOIN every USING (r)
    """


ORACLE_SQL: dict[str, str] = {
    "op12_licenses": license_sql(),
    "op2_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
        ), b AS (
            SELECT page_id, payload, octet_length(encode(payload)) AS payload_bytes,
                list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                    ((('0x' || substr(hex || '0', (5 * i) // 4 + 1, 2))::INT >> (3 - (5 * i) % 4)) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
                min(page_id) OVER (PARTITION BY payload) AS first_id
            FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM b
    """,
    "op5_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
        ), g AS (
            SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
    """,
}
