"""A corpus pipeline of five of the training-data operators: quality rules, language identification, SimHash near-dedup,
secret scans, packing. Each stage works on all that the one before it kept; each is written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from entityfusion.llm import language_id, packing, quality_rules, secret_scan, simhash
from entityfusion.llm.common import Scratch, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents that fail the base or a risk-controlled rule go."""
    return quality_rules.passing(docs, read_table(spark, sf_dir, "labels"), scratch or Scratch(spark, "pipeline-quality"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents without a recognised language go."""
    return language_id.in_a_language(docs, scratch or Scratch(spark, "pipeline-language"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8."""
    return simhash.without_near_duplicates(docs, scratch or Scratch(spark, "pipeline-near"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Secrets in texts are replaced by the name of their kind."""
    return secret_scan.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: sequences of at most 4096 tokens."""
    return packing.op9_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("language_id", language), ("simhash_near_dedup", near_dedup), ("secret_scans", secrets), ("best_fit_packing", pack)]

#: Tokenizers and trained models are beyond SQL; the tests compare the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and reread. Once a stage is written, its own tables and its input go."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        own = Scratch(spark, f"pipeline-{name}")
        kept = scratch.table(stage(spark, docs, sf_dir, own), name)
        own.close()
        scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
