"""Validation of projected records: problems as rows (candidate_id, path, code, message, expected, actual)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .projection import Config, walk

E164, ALPHA2, DATE = r"^\+[1-9]\d{1,14}$", "^[A-Z]{2}$", r"^\d{4}(-\d{2}(-\d{2})?)?$"
REQUIRED = ("candidate_id", "emails", "phones", "skills")


def _issue(path: Column, code: str, message: str, expected: str, actual: Column) -> Column:
    return F.struct(path.alias("path"), F.lit(code).alias("code"), F.lit(message).alias("message"), F.lit(expected).alias("expected"), actual.cast("string").alias("actual"))


def _shown(value: Column, kind: T.DataType) -> Column:
    return F.to_json(value) if isinstance(kind, T.StructType | T.ArrayType | T.MapType) else value.cast("string")


def missing_issue(name: str, value: Column, kind: T.DataType) -> Column:
    """An array of one issue if the value is null or empty."""
    empty = F.size(value) <= 0 if isinstance(kind, T.ArrayType) else value.cast("string") == "" if isinstance(kind, T.StringType) else F.lit(False)
    gone = value.isNull() | F.coalesce(empty, F.lit(False))
    return F.when(gone, F.array(_issue(F.lit(name), "missing_required_field", "Required field is missing or empty", "non-empty value", F.lit(None))))


def pattern_issues(name: str, value: Column, kind: T.DataType, pattern: str, code: str, message: str) -> Column:
    """An array of an issue for each value that doesn't match; nulls pass."""
    if isinstance(kind, T.ArrayType):
        rows = F.transform(value, lambda x, i: F.struct(i.alias("i"), x.cast("string").alias("x")))
        bad = F.filter(rows, lambda r: r["x"].isNotNull() & ~r["x"].rlike(pattern))
        return F.transform(bad, lambda r: _issue(F.concat(F.lit(f"{name}["), r["i"].cast("string"), F.lit("]")), code, message, pattern, r["x"]))
    text = _shown(value, kind)
    return F.when(text.isNotNull() & ~text.rlike(pattern), F.array(_issue(F.lit(name), code, message, pattern, text)))


def phone_issues(name: str, value: Column, kind: T.DataType) -> Column:
    return pattern_issues(name, value, kind, E164, "invalid_phone_format", "Phone is not in E.164 format")


def country_issues(name: str, value: Column, kind: T.DataType) -> Column:
    return pattern_issues(name, value, kind, ALPHA2, "invalid_country_code", "Country code is not ISO 3166 alpha-2")


def date_issues(name: str, value: Column, kind: T.DataType) -> Column:
    return pattern_issues(name, value, kind, DATE, "invalid_date_format", "Date is not YYYY, YYYY-MM or YYYY-MM-DD")


def type_issue(name: str, kind: T.DataType | None, wanted: type[T.DataType]) -> Column | None:
    """Of the declared schema: a field of another type is an issue of every record."""
    if kind is None or isinstance(kind, wanted):
        return None
    return F.array(_issue(F.lit(name), "invalid_type", f"Field is not of type {wanted.__name__}", wanted.__name__, F.lit(kind.simpleString())))


def validate(projected: DataFrame, config: Config, key: str = "candidate_id") -> DataFrame:
    """One row per issue; rules that are disabled are validated too. A valid record has no row."""
    kind = projected.schema
    record = F.struct(*(F.col(f"`{c}`") for c in projected.columns))
    at = lambda path: walk(record, kind, path.split("."))
    found: list[Column | None] = []
    if config.mode == "custom":
        for rule in config.rules:
            value, of = at(rule.target)
            if rule.required:
                found.append(missing_issue(rule.target, value, of))
            directive = (rule.normalize or "").strip().lower()
            if directive == "e164":
                found.append(phone_issues(rule.target, value, of))
            if directive == "iso3166":
                found.append(country_issues(rule.target, value, of))
    else:
        names = [*REQUIRED, *["provenance"] * config.include_provenance, *["overall_confidence"] * config.include_confidence]
        found += [missing_issue(n, *at(n)) for n in names]
        found += [type_issue(n, kind[n].dataType if n in kind.names else None, T.ArrayType) for n in ("emails", "phones", "skills", "experience", "education")]
        found += [phone_issues("phones", *at("phones")), country_issues("location.country_code", *at("location.country_code"))]
        found += [date_issues(f"experience[].{p}", *at(f"experience[].{p}")) for p in ("start", "end")]
    if config.include_confidence and "overall_confidence" in kind.names:
        found.append(type_issue("overall_confidence", kind["overall_confidence"].dataType, T.NumericType))
    none = F.array().cast("array<struct<path:string,code:string,message:string,expected:string,actual:string>>")
    parts = [F.coalesce(f, none) for f in found if f is not None]
    issues = reduce(lambda a, b: F.concat(a, b), parts, none)
    of_key = F.col(key) if key in projected.columns else F.lit(None).cast("string")
    return projected.select(of_key.alias(key), F.inline(issues))


def validity(projected: DataFrame, issues: DataFrame, key: str = "candidate_id") -> DataFrame:
    """candidate_id, errors, warnings (always 0), is_valid."""
    counts = issues.groupBy(key).agg(F.count(F.lit(1)).alias("errors"))
    errors = F.coalesce("errors", F.lit(0))
    return projected.select(key).join(counts, key, "left").select(key, errors.alias("errors"), F.lit(0).alias("warnings"), (errors == 0).alias("is_valid"))


def finalized(records: DataFrame, id_column: str = "candidate_id") -> DataFrame:
    """records, each of which must have an id: one without it ends the job with an error."""
    known = F.when(F.coalesce(F.col(id_column), F.lit("")) != "", F.col(id_column)).otherwise(F.raise_error(F.lit(f"a record without {id_column}")))
    return records.withColumn(id_column, known)
