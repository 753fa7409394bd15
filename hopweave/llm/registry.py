"""Queries of the training-data operators, with production parameters.

Each ``opN_<name>`` is thin: it hands the whole table to its operator and, where
a result is a text or a binary, derives digests from the operator's output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hopweave.llm import bytepair, chat, exactdedup, fingerprints, licenses, ngramjoin, packing, pii, quality, tokencount
from hopweave.llm.common import documents

#: The key of the registered queries; a deployment passes its own.
PII_KEY = "registered query"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepair.round_trip_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.labelled(spark, documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(spark, documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), PII_KEY)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labelled(spark, documents(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_digests(spark, documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.classify(spark, docs, quality.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.decisions(spark, documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_token_counts": op1_token_counts,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_chat_format": op3_chat_format,
    "op4_ngram_join": op4_ngram_join,
    "op5_packing": op5_packing,
    "op6_pii": op6_pii,
    "op7_license_scan": op7_license_scan,
    "op8_fingerprints": op8_fingerprints,
    "op9_quality": op9_quality,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLES: dict[str, str] = {
    "op10_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY bare) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               sha256(bare) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY bare ORDER BY n_chars DESC, doc_id)
    """,
}
