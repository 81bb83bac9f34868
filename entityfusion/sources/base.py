"""From parsed records to fragments. Every id is a hash of where the record stands, so a repeated task makes the same ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound
from ..schemas import FIELDS

#: Sources by name; ``register`` adds to them.
REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    def add(reader: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REGISTRY[name] = reader
        return reader

    return add


def fragments_of(records: DataFrame, parsed: str = "parsed") -> DataFrame:
    """frag_ord, frag_id and FIELDS. records: frag_ord, parsed, and ``raw`` for the hash of the record."""
    made = records.withColumn("frag_id", F.sha2(F.concat_ws("::", F.col("frag_ord").cast("string"), F.col("raw")), 256))
    p = lambda c: F.col(f"{parsed}.{c}")
    columns = {c: p(c) for c in FIELDS} | {"raw_hash": F.sha2("raw", 256)}
    evidence = F.transform(p("evidence"), lambda e, i: e.withField("evidence_id", F.sha2(F.concat_ws("::", F.col("frag_id"), e["field"], i.cast("string")), 256)))
    columns["evidence"] = F.coalesce(evidence, F.array().cast(f"{FIELDS['evidence']}"))
    out = made.select("frag_ord", "frag_id", *(v.alias(k) for k, v in columns.items()))
    return out.withColumns({c: with_evidence(c) for c in ("skills", "experience", "education")} | {c: with_all_evidence(c) for c in ("emails", "phones")})


def with_evidence(field: str) -> Column:
    """A list's items with the ids of their evidence: of the piece of their field in the same place, or of its only one."""
    ids = F.transform(F.filter("evidence", lambda e: e["field"] == field), lambda e: e["evidence_id"])
    known = lambda of, i: F.when(F.size(of) == F.size(field), F.get(of, i)).when(F.size(of) == 1, F.get(of, F.lit(0)))
    return bound(ids, lambda of: F.transform(field, lambda x, i: x.withField("evidence_ids", F.array_compact(F.array_append(x["evidence_ids"], known(of, i))))))


def with_all_evidence(field: str) -> Column:
    """A list's items, each with the ids of all evidence of their field."""
    ids = F.transform(F.filter("evidence", lambda e: e["field"] == field), lambda e: e["evidence_id"])
    return bound(ids, lambda of: F.transform(field, lambda x: x.withField("evidence_ids", F.array_distinct(F.concat(F.coalesce(x["evidence_ids"], no_ids()), of)))))


def null() -> Column:
    return F.lit(None).cast("string")


def no_ids() -> Column:
    return F.array().cast("array<string>")


def piece(field: str, value: Column, method: str, rule: str, canonical: Column | None = None) -> Column:
    """One piece of evidence as a struct; ``fragments_of`` gives it its id."""
    return F.struct(null().alias("evidence_id"), F.lit(field).alias("field"), value.alias("original"), (value if canonical is None else canonical).alias("canonical"), F.lit(method).alias("method"), F.lit(rule).alias("rule"), F.lit(1.0).alias("confidence"))


def email_items(emails: Column) -> Column:
    return F.transform(emails, lambda e: F.struct(e.alias("value"), e.alias("normalized"), F.lit(1.0).alias("confidence"), no_ids().alias("evidence_ids")))


def phone_items(phones: Column) -> Column:
    return F.transform(phones, lambda p: F.struct(p.alias("raw"), p.alias("e164"), F.lit(1.0).alias("confidence"), no_ids().alias("evidence_ids")))


def skill_items(names: Column, source: str) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.array(n).alias("original_names"), null().alias("category"), null().alias("parent_category"), F.lit(1.0).alias("confidence"), F.array(F.lit(source)).alias("sources"), no_ids().alias("evidence_ids")))


def record(**parts: Column) -> Column:
    """A parsed record typed as FIELDS; what is not given is null."""
    return F.struct(*(parts.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in FIELDS.items()))
