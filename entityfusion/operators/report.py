"""Aggregates of a run: the console summary and the dashboard's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_summary(records: DataFrame, validity: DataFrame) -> DataFrame:
    """One row: candidates, mean_confidence, errors, warnings."""
    joined = records.select("candidate_id", "overall_confidence").join(validity, "candidate_id", "left")
    return joined.agg(F.count(F.lit(1)).alias("candidates"), F.avg("overall_confidence").alias("mean_confidence"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"))


def field_means(fields: DataFrame) -> DataFrame:
    """field, mean_score, count: over all candidates, by field."""
    return fields.groupBy("field").agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("count")).orderBy("field")


def field_scores(fields: DataFrame, bins: int = 100) -> DataFrame:
    """field, score, count: how often each score occurs, rounded to 1 / bins, so no field's scores are held together."""
    return fields.groupBy("field", (F.round(F.col("score") * bins) / bins).alias("score")).agg(F.count(F.lit(1)).alias("count"))


def component_means(fields: DataFrame) -> DataFrame:
    """component, mean: over all fields of all candidates."""
    names = ("reliability", "agreement", "quality", "certainty", "conflict")
    means = fields.agg(*(F.avg(c).alias(c) for c in names))
    return means.select(F.inline(F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).alias("mean")) for c in names))))


def first_breakdown(fields: DataFrame, by: str = "cluster") -> DataFrame:
    """The fields of the first candidate."""
    first = fields.agg(F.min(by).alias(by))
    return fields.join(F.broadcast(first), by, "left_semi").select("field", "score", "reliability", "agreement", "quality", "certainty", "conflict").orderBy("field")


def provenance_table(provenance: DataFrame, transformations: DataFrame) -> DataFrame:
    """kind, field, original, canonical, method: provenance, then every transformation."""
    a = provenance.select(F.lit("provenance").alias("kind"), "field", "original", "canonical", "method")
    return a.unionByName(transformations.select(F.lit("transformation").alias("kind"), "field", "original", "canonical", F.col("stage").alias("method")))


def passed_checks(projected: DataFrame, issues: DataFrame, codes: tuple[str, ...] = ("missing_required_field", "invalid_phone_format", "invalid_country_code", "invalid_date_format")) -> DataFrame:
    """code, failed, passed: how many candidates have an issue of each code."""
    total = projected.agg(F.count(F.lit(1)).alias("n"))
    failed = issues.groupBy("code").agg(F.countDistinct("candidate_id").alias("failed"))
    every = total.select("n", F.explode(F.array(*map(F.lit, codes))).alias("code"))
    return every.join(failed, "code", "left").select("code", F.coalesce("failed", F.lit(0)).alias("failed"), (F.col("n") - F.coalesce("failed", F.lit(0))).alias("passed"))
