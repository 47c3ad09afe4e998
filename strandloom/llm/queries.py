"""One query for each operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import (
    bpe_automaton, chat_format, exact_dedup, html_extract, language_id, near_dedup, packing, quality_rules, secret_scan, token_alignment,
    token_counts, topk_mtree, whitening,
)
from strandloom.llm.common import table


def op1_topk_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_mtree.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.link_calls(*chat_format.conversation_calls(table(spark, sf_dir, "conversations")), chat_format.ASK)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.classify(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")), at_least=0.7)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048), capacity=2048)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"), components=16, scale=64, shift=1_000_000)
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.secret_spans(table(spark, sf_dir, "documents")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment.alignment(table(spark, sf_dir, "documents"), *paths, links="ends")


OPERATORS = (
    op1_topk_mtree, op2_token_counts, op3_bpe_round_trip, op4_exact_dedup, op5_html_extract, op6_language_id, op7_chat_format, op8_near_dedup,
    op9_quality_rules, op10_best_fit_packing, op11_whitening, op12_secret_scan, op13_token_alignment,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk_mtree": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            scored AS (
                SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
                FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
            SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
        "op4_exact_dedup": """
            WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
            FROM t WINDOW w AS (PARTITION BY text)""",
        "op7_chat_format": """
            WITH asks AS (SELECT conv_id, turn, min(text) AS prompt FROM conversations WHERE role = 'user' GROUP BY ALL),
            answers AS (SELECT conv_id, turn - 1 AS turn, min(text) AS result, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL),
            linked AS (
                SELECT conv_id, turn, prompt, result, n IS NOT NULL AS linked,
                       row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position
                FROM asks LEFT JOIN answers USING (conv_id, turn))
            SELECT conv_id, 't' || turn AS call_id, position, linked, coalesce(length(prompt) >= 1, false) AS valid,
                   '{"arguments":' || CASE WHEN prompt IS NULL THEN '{}' ELSE '{"prompt":' || to_json(prompt)::VARCHAR || '}' END
                   || ',"id":"t' || turn || '","name":"ask","position":' || position
                   || ',"result":' || coalesce(to_json(result)::VARCHAR, 'null') || '}' AS json
            FROM linked""",
    }
