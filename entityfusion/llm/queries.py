"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, exact_dedup, language_id, packing, quality_classifier, quality_rules, runs, secret_scan, simhash, token_counts, vector_search, warc
from .common import read_table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op1_warc(spark, sf_dir)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op2_simhash(read_table(spark, sf_dir, "documents"))


def op3_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.op3_vector_search(read_table(spark, sf_dir, "embeddings"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return bpe.op4_byte_bpe(documents, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.op5_quality_classifier(spark, sf_dir)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op6_quality_rules(spark, sf_dir)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op7_token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op8_language_id(read_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op9_packing(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op10_secret_scan(read_table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.op11_alignment(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.op12_periodic_runs(read_table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.op13_exact_dedup(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_simhash, op3_vector_search, op4_byte_bpe, op5_quality_classifier, op6_quality_rules, op7_token_counts, op8_language_id, op9_packing, op10_secret_scan, op11_alignment, op12_periodic_runs, op13_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.ORACLE_SQL, "op6_quality_rules": quality_rules.oracle_sql(), "op13_exact_dedup": exact_dedup.ORACLE_SQL}
