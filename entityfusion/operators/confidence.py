"""Confidence of fields and of whole records: plain arithmetic over aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import clamp
from ..settings import DEFAULT, Settings
from .dictionary import STAGES
from .fusion import lookup

#: Fields in order, what counts as evidence of each, and what missing ones cost.
FIELDS = ("full_name", "emails", "phones", "location", "links", "headline", "years_experience", "skills", "experience", "education")
ALIASES = {"emails": ("emails", "email"), "phones": ("phones", "phone"), "location": ("location", "country", "city"), "experience": ("experience", "company", "job_title"), "education": ("education", "degree")}
SCALARS = ("full_name", "headline", "years_experience", "location")
MISSING = {"full_name": 0.25, "emails": 0.25, "phones": 0.25, "skills": 0.25}
CATEGORIES = {"identity": ("full_name", "emails", "phones", "links"), "experience": ("experience", "years_experience"), "skills": ("skills",), "education": ("education",), "location": ("location",), "context": ("headline",)}


def _map(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def field_of(name: Column) -> Column:
    """The scored field that an evidence field counts for."""
    back = {a: f for f, aliases in ALIASES.items() for a in aliases}
    return F.coalesce(_map(back)[name], name)


def agreement(sources: Column) -> Column:
    """1 - 2^-n for n sources."""
    return F.when(sources > 0, 1 - F.pow(F.lit(2.0), -sources)).otherwise(0.0)


def conflict(distinct_values: Column, field: Column) -> Column:
    """(u - 1) / u for u distinct values of a scalar field."""
    return F.when(field.isin(*SCALARS) & (distinct_values > 1), (distinct_values - 1) / distinct_values).otherwise(0.0)


def missing(values: Column, field: Column) -> Column:
    return F.when(values > 0, 0.0).otherwise(F.coalesce(_map(MISSING)[field], F.lit(0.10)))


def score(reliability: Column, agreement_: Column, quality: Column, certainty: Column, conflict_: Column, missing_: Column, settings: Settings = DEFAULT) -> Column:
    w = settings.weights
    parts = {"reliability": reliability, "agreement": agreement_, "quality": quality, "certainty": certainty}
    total = sum(w[n] for n in parts)
    positive = (parts["reliability"] * w["reliability"] + parts["agreement"] * w["agreement"] + parts["quality"] * w["quality"] + parts["certainty"] * w["certainty"]) / total if total else F.lit(0.0)
    return clamp(positive - conflict_ * w["conflict"] - missing_ * w["missing"])


def source_reliability(sources: DataFrame, by: str = "cluster", settings: Settings = DEFAULT) -> DataFrame:
    """cluster, field, base, adjusted, overridden: means over distinct sources; the adjusted one over overrides only, where there is any.

    sources: cluster, field, source."""
    each = sources.select(by, "field", "source").filter("source is not null").distinct()
    base = F.coalesce(lookup(F.col("source"), settings.reliability), F.lit(settings.default_reliability))
    override = lookup(F.concat_ws("/", "source", "field"), {f"{s}/{f}": v for s, o in settings.overrides.items() for f, v in o.items()})
    out = each.groupBy(by, "field").agg(F.avg(base).alias("base"), F.avg(override).alias("over"), F.count(F.lit(1)).alias("source_count"))
    return out.select(by, "field", "base", F.coalesce("over", "base").alias("adjusted"), F.col("over").isNotNull().alias("overridden"), "source_count")


def reason_codes(adjusted: Column, overridden: Column, agreement_: Column, quality: Column, stages: Column, conflict_: Column, missing_: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(adjusted >= 0.8, "high_source_reliability"),
            F.when(overridden, "field_reliability_override"),
            F.when(agreement_ >= 0.75, "strong_cross_source_agreement").otherwise("weak_cross_source_agreement"),
            F.when(quality >= 0.8, "high_extraction_quality"),
            F.when(F.array_contains(stages, "EXACT_ALIAS"), "semantic_alias_match"),
            F.when(F.array_contains(stages, "FUZZY_MATCH"), "semantic_fuzzy_match"),
            F.when(conflict_ > 0, "unresolved_conflict"),
            F.when(missing_ > 0, "missing_evidence"),
        )
    )


def field_confidence(clusters: DataFrame, evidence: DataFrame, values: DataFrame, transformations: DataFrame, summaries: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One row per cluster and field: score, its components, source_count, reason_codes.

    clusters: cluster. evidence: cluster, field, source, quality (repeats count). values: cluster, field, value (the values on which sources may
    disagree, items of lists included). transformations: cluster, field, stage. summaries: cluster, source (used where a field has no evidence)."""
    grid = clusters.select("cluster").distinct().select("cluster", F.explode(F.array(*map(F.lit, FIELDS))).alias("field"))
    told = lambda df: df.withColumn("field", field_of(F.col("field"))).filter(F.col("field").isin(*FIELDS))
    evidence, values, transformations = told(evidence), told(values), told(transformations)
    direct = evidence.select("cluster", "field", "source").filter("source is not null").distinct()
    lacking = grid.join(direct.select("cluster", "field").distinct(), ["cluster", "field"], "left_anti")
    sources = direct.union(lacking.join(summaries.select("cluster", "source").distinct(), "cluster").select("cluster", "field", "source"))
    by = ["cluster", "field"]
    quality = evidence.groupBy(by).agg(F.avg("quality").alias("quality"))
    seen = values.filter("value is not null and value <> ''").groupBy(by).agg(F.count(F.lit(1)).alias("n_values"), F.countDistinct("value").alias("n_distinct"))
    stages = transformations.groupBy(by).agg(F.avg(F.coalesce(_map(STAGES)[F.col("stage")], F.lit(0.0))).alias("certainty"), F.collect_set("stage").alias("stages"))
    all_ = grid.join(source_reliability(sources, settings=settings), by, "left").join(quality, by, "left").join(seen, by, "left").join(stages, by, "left")
    n = F.coalesce("n_values", F.lit(0))
    # a location counts its seven parts as values too
    u = F.coalesce("n_distinct", F.lit(0)) + F.when(F.col("field") == "location", 7).otherwise(0)
    n = n + F.when(F.col("field") == "location", 7).otherwise(0)
    parts = all_.select(
        *by, F.coalesce("base", F.lit(0.5)).alias("base"), F.coalesce("adjusted", F.lit(0.5)).alias("reliability"), F.coalesce("overridden", F.lit(False)).alias("overridden"), F.coalesce("source_count", F.lit(0)).alias("source_count"),
        agreement(F.coalesce("source_count", F.lit(0))).alias("agreement"), F.coalesce("quality", F.lit(0.5)).alias("quality"), F.coalesce("certainty", F.when(n > 0, 1.0).otherwise(0.0)).alias("certainty"),
        F.coalesce("stages", F.array().cast("array<string>")).alias("stages"), conflict(u, F.col("field")).alias("conflict"), missing(n, F.col("field")).alias("missing"),
    )
    names = ("reliability", "agreement", "quality", "certainty", "conflict", "missing")
    reasons = reason_codes(*(F.col(c) for c in ("reliability", "overridden", "agreement", "quality", "stages", "conflict", "missing")))
    return parts.select("*", score(*(F.col(c) for c in names), settings).alias("score"), reasons.alias("reason_codes"))


def category_scores(fields: DataFrame, by: str = "cluster", settings: Settings = DEFAULT) -> DataFrame:
    """cluster, category, score, weight: means of the category's fields, weighted by sources, one at least."""
    of = _map({f: c for c, names in CATEGORIES.items() for f in names})
    w = F.greatest(F.col("source_count"), F.lit(1))
    out = fields.withColumn("category", of[F.col("field")]).filter("category is not null").groupBy(by, "category").agg((F.sum(F.col("score") * w) / F.sum(w)).alias("score"))
    return out.withColumn("weight", lookup(F.col("category"), settings.category_weights))


def capped(weighted: Column, most_sources: Column, conflicting: Column, fields: Column, settings: Settings = DEFAULT) -> Column:
    """At most one cap if every field has one source; at most another if half of the fields conflict."""
    out = F.when(most_sources <= 1, F.least(weighted, F.lit(settings.caps["single_source"]))).otherwise(weighted)
    return clamp(F.when(2 * conflicting >= fields, F.least(out, F.lit(settings.caps["conflict"]))).otherwise(out))


def overall_confidence(fields: DataFrame, by: str = "cluster", settings: Settings = DEFAULT) -> DataFrame:
    """cluster, overall: weighted mean of the categories present, capped. Without category weights the fields' mean weighted by sources, capped;
    where no category present has a weight their plain mean."""
    w = F.greatest(F.col("source_count"), F.lit(1))
    facts = fields.groupBy(by).agg(F.max("source_count").alias("most"), F.count_if(F.col("conflict") > 0).alias("conflicts"), F.count(F.lit(1)).alias("n"), F.avg("score").alias("plain"), (F.sum(F.col("score") * w) / F.sum(w)).alias("by_sources"))
    cap = lambda weighted: capped(weighted, F.col("most"), F.col("conflicts"), F.col("n"), settings)
    if not settings.category_weights:
        return facts.select(by, cap(F.col("by_sources")).alias("overall"))
    weighted = category_scores(fields, by, settings).filter("weight is not null").groupBy(by).agg(F.sum("weight").alias("total"), F.sum(F.col("score") * F.col("weight")).alias("sum"))
    return facts.join(weighted, by, "left").select(by, F.when(F.col("total") > 0, cap(F.col("sum") / F.col("total"))).otherwise(F.col("plain")).alias("overall"))


def mean_breakdown(fields: DataFrame, by: str = "cluster") -> DataFrame:
    """cluster and the mean of each component over its fields."""
    return fields.groupBy(by).agg(*(F.avg(c).alias(c) for c in ("reliability", "base", "agreement", "quality", "certainty", "conflict")), F.max("overridden").alias("overridden"))


def debug_summary(fields: DataFrame, by: str = "cluster") -> DataFrame:
    """cluster, summary: one line per field, in order, with what raised and lowered it."""
    order = _map({f: i for i, f in enumerate(FIELDS)})
    text = F.format_string("%s: %.3f (+%s -%s)", "field", "score", F.concat_ws(",", F.filter("reason_codes", lambda c: c.rlike("^(high|strong|field|semantic)"))), F.concat_ws(",", F.filter("reason_codes", lambda c: c.rlike("^(weak|unresolved|missing)"))))
    return fields.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order[F.col("field")].alias("o"), text.alias("t")))), lambda x: x["t"]), "\n").alias("summary"))
