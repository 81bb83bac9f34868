"""Projection of canonical records into an output shape: rules compiled to Columns by the schema, so Catalyst prunes what they don't read.

Canonical records: candidate_id, full_name, emails, phones, location, links, headline, years_experience, skills, experience, education,
provenance, overall_confidence (see ``schemas.CANONICAL``)."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null, dedupe_keep_order, normalize_whitespace
from ..functions.values import normalize_email, normalize_phone

#: Country names and their codes for ``iso3166``.
ISO3166 = {"united states": "US", "usa": "US", "us": "US", "india": "IN", "germany": "DE", "united kingdom": "GB", "uk": "GB", "canada": "CA"}


@dataclass(frozen=True)
class Rule:
    source: str
    target: str
    normalize: str | None = None
    operation: str = "select"
    required: bool = False
    enabled: bool = True


@dataclass(frozen=True)
class Config:
    mode: str = "default"
    rules: tuple[Rule, ...] = ()
    include_provenance: bool = True
    include_confidence: bool = True
    on_missing: str = "null"
    more: dict = field(default_factory=dict, hash=False, compare=False)


def config_from(data: dict) -> Config:
    """A ``fields`` list (paths, or objects with path, from, normalize) makes a custom projection, even when empty; ``rules`` do with the mode that stands beside them."""
    missing = str(data.get("on_missing", data.get("missing_value_strategy", "null"))).lower()
    if missing not in ("null", "omit", "error"):
        raise ValueError(f"on_missing: {missing}")
    flags = {"include_provenance": bool(data.get("include_provenance", True)), "include_confidence": bool(data.get("include_confidence", True)), "on_missing": missing, "more": data}
    if "fields" in data:
        each = [{"path": f} if isinstance(f, str) else f for f in data["fields"] or ()]
        rules = [Rule(f.get("from") or f["path"], f["path"], f.get("normalize"), f.get("operation", "select"), bool(f.get("required", False)), bool(f.get("enabled", True))) for f in each]
        return Config("custom", tuple(rules), **flags)
    rules = [Rule(r["source_path"], r["target_path"], r.get("normalize"), r.get("operation", "select"), bool(r.get("required", False)), bool(r.get("enabled", True))) for r in data.get("rules") or ()]
    return Config(str(data.get("mode", "default")).lower(), tuple(rules), **flags)


def load_config(source: dict | str, folder: str | None = None) -> Config:
    """From a dictionary, or a JSON or YAML file; relative paths are tried below ``folder`` first."""
    if isinstance(source, dict):
        return config_from(source)
    path = next((p for p in (*([Path(folder) / source] if folder else []), Path(source)) if p.exists()), None)
    if path is None:
        raise FileNotFoundError(f"projection config: {source}")
    text = path.read_text(encoding="utf-8-sig")
    if path.suffix.lower() in (".yml", ".yaml"):
        import yaml

        return config_from(yaml.safe_load(text) or {})
    if path.suffix.lower() == ".json":
        return config_from(json.loads(text))
    raise ValueError(f"projection config: unknown kind {path.suffix}")


TOKEN = re.compile(r"^([^\[\]]+)(?:\[(-?\d*)\])?$")


def walk(value: Column, kind: T.DataType, path: list[str]) -> tuple[Column, T.DataType]:
    """The value at a path: ``a.b``, ``a[i]``, ``a[]`` (all items). What isn't there is null."""
    nothing = F.lit(None).cast("string"), T.StringType()
    if not path:
        return value, kind
    if not (m := TOKEN.match(path[0])):
        return nothing
    name, index = m.groups()
    if not isinstance(kind, T.StructType) or name not in kind.names:
        return nothing
    value, kind = value[name], kind[name].dataType
    if index is None:
        return walk(value, kind, path[1:])
    if not isinstance(kind, T.ArrayType):
        return nothing if index else (F.array().cast("array<string>"), T.ArrayType(T.StringType()))
    if index == "":
        inner = walk(F.lit(None).cast(kind.elementType), kind.elementType, path[1:])[1]
        return F.transform(value, lambda x: walk(x, kind.elementType, path[1:])[0]), T.ArrayType(inner)
    if int(index) < 0:
        return nothing
    return walk(F.get(value, int(index)), kind.elementType, path[1:])


def scalar(value: Column, kind: T.DataType) -> Column:
    """What stands for an object where a scalar is shown: e-mails normalised, phones in E.164, locations raw, skills by name, others as they are."""
    if isinstance(kind, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if not isinstance(kind, T.StructType):
        return value
    shown = []
    for name, use in (("normalized", normalize_email), ("e164", normalize_phone), ("value", normalize_whitespace), ("raw", normalize_whitespace), ("name", normalize_whitespace)):
        if name in kind.names:
            shown.append(blank_to_null(use(value[name])))
    return F.coalesce(*shown) if shown else value


def directed(value: Column, kind: T.DataType, directive: str) -> Column:
    names = kind.names if isinstance(kind, T.StructType) else []
    text = value.cast("string") if not names else F.to_json(value)
    if directive == "e164":
        return normalize_phone(F.coalesce(*(blank_to_null(value[n]) for n in ("e164", "raw") if n in names)) if {"e164", "raw"} & {*names} else text)
    if directive == "canonical":
        return normalize_whitespace(value["name"] if "name" in names else text)
    if directive == "iso3166":
        named = blank_to_null(normalize_whitespace(value["raw"] if "raw" in names else text))
        table = F.create_map(*(F.lit(x) for kv in ISO3166.items() for x in kv))
        from_name = F.coalesce(table[F.lower(named)], F.upper(named))
        return F.coalesce(F.upper(blank_to_null(normalize_whitespace(value["country_code"]))), from_name) if "country_code" in names else from_name
    return value


def compiled(rule: Rule, record: Column, kind: T.StructType) -> tuple[Column, Column]:
    """The rule's value, and whether it is missing (null, or an empty list)."""
    value, found = walk(record, kind, rule.source.split("."))
    directive = rule.normalize.strip().lower() if rule.normalize else None
    if isinstance(found, T.ArrayType):
        item = found.elementType
        if directive is None:
            value = F.transform(value, lambda x: scalar(x, item))
        else:
            value = dedupe_keep_order(F.transform(value, lambda x: directed(x, item, directive)))
        return value, value.isNull() | (F.size(value) == 0)
    value = scalar(value, found) if directive is None else directed(value, found, directive)
    return value, value.isNull()


def nested(targets: dict[str, Column]) -> list[Column]:
    """Columns of dotted targets as sub-objects."""
    tree: dict = {}
    for path, value in targets.items():
        at = tree
        *heads, last = path.split(".")
        for h in heads:
            at = at.setdefault(h, {})
        at[last] = value
    build = lambda t: [(F.struct(*build(v)) if isinstance(v, dict) else v).alias(k) for k, v in t.items()]
    return build(tree)


def project_custom(records: DataFrame, config: Config) -> DataFrame:
    """Columns for the enabled rules' targets, then provenance and confidence as the flags say, unless a rule made them."""
    record, kind = F.struct(*(F.col(f"`{c}`") for c in records.columns)), records.schema
    targets: dict[str, Column] = {}
    for rule in config.rules:
        if not rule.enabled:
            continue
        value, gone = compiled(rule, record, kind)
        if config.on_missing == "error":
            value = F.when(gone, F.raise_error(F.lit(f"Missing projected field: {rule.target}"))).otherwise(value)
        else:
            value = F.when(~gone, value)
        targets[rule.target] = value
    for name, flag in (("provenance", config.include_provenance), ("overall_confidence", config.include_confidence)):
        if flag and name not in targets and name in records.columns:
            targets[name] = F.col(name)
    return records.select(*nested(targets))


def project_default(records: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """The fixed output shape: canonical names before raw ones, dates as ISO texts."""
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    experience = F.transform("experience", lambda x: F.struct(F.coalesce(x["company_canonical"], x["company"]).alias("company"), F.coalesce(x["title_canonical"], x["title"]).alias("title"), iso(x["start"]).alias("start"), iso(x["end"]).alias("end"), x["summary"].alias("summary")))
    education = F.transform("education", lambda x: F.struct(x["institution"].alias("institution"), F.coalesce(x["degree_canonical"], x["degree"]).alias("degree"), x["field"].alias("field"), x["start_year"].alias("start_year"), x["end_year"].alias("end_year")))
    skills = F.transform("skills", lambda s: F.struct(s["name"].alias("name"), s["confidence"].alias("confidence"), s["sources"].alias("sources")))
    out = [
        F.col("candidate_id"), F.col("full_name"), F.transform("emails", lambda e: e["normalized"]).alias("emails"), F.transform("phones", lambda p: F.coalesce(p["e164"], p["raw"])).alias("phones"),
        F.struct("location.city", "location.region", "location.country").alias("location"), F.col("links"), F.col("headline"), F.col("years_experience"), skills.alias("skills"), experience.alias("experience"), education.alias("education"),
    ]
    out += [F.col("provenance")] * (config.include_provenance and "provenance" in records.columns) + [F.col("overall_confidence")] * config.include_confidence
    return records.select(*out)


def project(records: DataFrame, config: Config) -> DataFrame:
    return project_custom(records, config) if config.mode == "custom" else project_default(records, config)


def as_json(projected: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """payload: one JSON object a row; nulls are left out for ``omit`` and the default shape, kept for ``null``."""
    keep = config.mode == "custom" and config.on_missing == "null"
    return projected.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in projected.columns)), {"ignoreNullFields": str(not keep).lower()}).alias("payload"))
