"""Audit trails: removing repeated records, enriching and compacting provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe_last(records: DataFrame, key: str, order: str = "ord", by: str = "cluster") -> DataFrame:
    """Records once per id: at the place of the first, with the contents of the last."""
    rest = [c for c in records.columns if c not in (by, key, order)]
    return records.groupBy(by, key).agg(F.min(order).alias(order), F.max_by(F.struct(*rest), order).alias("last")).select(by, key, order, "last.*")


def distinct_provenance(records: DataFrame, order: str = "ord", by: str = "cluster") -> DataFrame:
    """Provenance once per field, source, method and original value: the first of each."""
    keys = [by, "field", "source", "method", "original"]
    rest = [c for c in records.columns if c not in (*keys, order)]
    return records.groupBy(*keys).agg(F.min(order).alias(order), F.min_by(F.struct(*rest), order).alias("first")).select(*keys, order, "first.*")


def source_summaries(sources: DataFrame, by: str = "cluster") -> DataFrame:
    """Sources once per record id, or per name and file where there is none: the first of each. sources: cluster, ord, source, record_id, source_file, quality."""
    key = F.when(F.coalesce("record_id", F.lit("")) != "", F.col("record_id")).otherwise(F.concat_ws(":", "source", "source_file"))
    return sources.withColumn("source_key", key).groupBy(by, "source_key").agg(F.min_by(F.struct("ord", "source", "record_id", "source_file", "quality"), "ord").alias("first")).select(by, "source_key", "first.*")


def enrich(stored: DataFrame, evidence: DataFrame, decisions: DataFrame) -> DataFrame:
    """Stored provenance, then one row for each piece of evidence, then one for each merge decision."""
    cols = ["cluster", "ord", "field", "original", "canonical", "source", "method", "rule", "confidence", "record_id"]
    made = decisions.select("cluster", "ord", "field", F.to_json("competing").alias("original"), F.to_json("selected").alias("canonical"), F.lit("fusion").alias("source"), F.lit("merge").alias("method"), F.col("strategy").alias("rule"), "confidence", F.lit(None).cast("string").alias("record_id"))
    parts = [stored.select(*cols), evidence.select(*cols), made.select(*cols)]
    ranked = [p.withColumn("ord", F.struct(F.lit(i).alias("part"), F.col("ord").cast("decimal(38,0)").alias("at"))) for i, p in enumerate(parts)]
    return ranked[0].unionByName(ranked[1]).unionByName(ranked[2])


def _values(column: str, order: str) -> Column:
    """Distinct values in order of first appearance; null and empty ones left out."""
    at = F.transform(F.sort_array(F.collect_list(F.struct(order, column))), lambda x: x[column])
    return F.array_distinct(F.filter(at, lambda v: v.isNotNull() & (v != "")))


def compact_provenance(records: DataFrame, order: str = "ord", by: str = "cluster") -> DataFrame:
    """One row per field, source, method and rule: distinct originals and canonicals (a scalar if there is one), the highest confidence, the ids of the
    records that say so joined by bars, in order of appearance."""
    ids = _values("record_id", order) if "record_id" in records.columns else F.array().cast("array<string>")
    made = records.groupBy(by, "field", "source", "method", "rule").agg(F.min(order).alias(order), _values("original", order).alias("o"), _values("canonical", order).alias("c"), F.max("confidence").alias("confidence"), F.array_join(ids, " | ").alias("record_ids"), F.count(F.lit(1)).alias("n"))
    one = lambda c: F.when(F.size(c) == 1, F.col(c)[0]).when(F.size(c) > 1, F.to_json(F.col(c)))
    return made.select(by, "field", "source", "method", "rule", order, one("o").alias("original"), one("c").alias("canonical"), "confidence", "record_ids", "n")


def numbered(records: DataFrame, *order: str, by: str = "cluster") -> DataFrame:
    """records with ``ord``: their place within the cluster."""
    return records.withColumn("ord", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
