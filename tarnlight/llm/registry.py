"""The queries of this subpackage and of the pipeline, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tarnlight.llm import alignment, exact_dedup, line_dedup, minhash, mixing, packing, phrases, quality_rules, sanitising, secret_scan, sharding, token_binary, token_counts

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"
BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op1_line_dedup(spark, documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(WORD_VOCABULARY))


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.token_matrices(documents(spark, sf_dir), public_tokenizers.path(WORD_VOCABULARY))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.op4_minhash_near_dedup(spark, documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.op5_exact_dedup(spark, documents(spark, sf_dir))


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op6_kd_sharding(spark, documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op7_quality_rules(spark, documents(spark, sf_dir))


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op8_pareto_mix(spark, documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path(WORD_VOCABULARY))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(documents(spark, sf_dir), public_tokenizers.path(BYTE_RANKS))


def op11_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitising.op11_sanitisation(spark, documents(spark, sf_dir))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.op12_phrase_collocations(spark, documents(spark, sf_dir))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(documents(spark, sf_dir), public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.path(PIECE_MODEL))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_line_dedup, op2_packing, op3_token_binary, op4_minhash_near_dedup, op5_exact_dedup, op6_kd_sharding, op7_quality_rules, op8_pareto_mix, op9_token_counts, op10_secret_scan, op11_sanitisation, op12_phrase_collocations, op13_tokenizer_alignment)
    return {query.__name__: query for query in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    sql = {"op1_line_dedup": line_dedup.SQL, "op5_exact_dedup": exact_dedup.SQL, "op12_phrase_collocations": phrases.SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: text for name, text in sql.items() if text}
