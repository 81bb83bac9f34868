"""Merging the fragments of a cluster field by field.

Each function takes long tables keyed by ``cluster`` with explicit ordinals, so results don't depend on partitioning. All but the
folds of experiences and educations are plain aggregates that combine before the shuffle; the folds depend on order and
are not associative, so they stream a cluster's items in order, those of a large cluster by components of what can ever meet."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import sequence_ratio
from ..functions.text import blank_to_null
from ..functions.values import location_completeness, normalize_url
from ..plans.tables import PARENTS, Tables, components, few
from ..settings import DEFAULT, Settings


def lookup(source: Column, table: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[source] if table else F.lit(None).cast("double")


def reliability(source: Column, field: str | None = None, settings: Settings = DEFAULT) -> Column:
    """Of a source for a field: the field's own figure, the source's, or the default."""
    own = {s: o[field] for s, o in settings.overrides.items() if field in o}
    return F.coalesce(lookup(source, own), lookup(source, settings.reliability), F.lit(settings.default_reliability))


def best_by_reliability(items: DataFrame, value: str, score: Column, order: str = "ord", by: str = "cluster") -> DataFrame:
    """cluster, value: the value of the highest score, the earliest of equals."""
    given = items.filter(F.col(value).isNotNull() & (F.col(value).cast("string") != ""))
    return given.groupBy(by).agg(F.max_by(value, F.struct(score, -F.col(order))).alias(value))


def max_verified(items: DataFrame, value: str, score: Column, by: str = "cluster") -> DataFrame:
    """cluster, value, score: the largest value, with the best score among its sources."""
    best = F.max(F.struct(F.col(value).alias("value"), score.alias("score")))
    return items.filter(F.col(value).isNotNull()).groupBy(by).agg(best.alias("best")).select(by, F.col("best.value").alias(value), F.col("best.score").alias("score"))


def union_values(items: DataFrame, key: str, confidence: Column, first: tuple[str, ...] = (), lists: tuple[str, ...] = (), order: str = "ord", by: str = "cluster") -> DataFrame:
    """One row per distinct key of a cluster: position, first-seen attributes, the highest confidence, unions of lists in order."""
    one = F.struct(order, *lists)
    out = items.filter(F.col(key).isNotNull()).groupBy(by, key).agg(
        F.min(order).alias(order), F.max(confidence).alias("confidence"), *(F.min_by(c, order).alias(c) for c in first), F.sort_array(F.collect_list(one)).alias("_all")
    )
    return out.withColumns({c: F.array_distinct(F.flatten(F.filter(F.col(f"_all.{c}"), lambda x: x.isNotNull()))) for c in lists}).drop("_all")


def most_complete(items: DataFrame, score: Column, order: str = "ord", by: str = "cluster") -> DataFrame:
    """cluster, location, completeness: the location with most parts, then of the highest score, then the earliest.

    items: cluster, ord, location (city, region, country, country_code, raw)."""
    parts = location_completeness(*(F.col(f"location.{c}") for c in ("city", "region", "country", "country_code")))
    best = F.max_by(F.struct("location", parts.alias("completeness")), F.struct(parts, score, -F.col(order)))
    return items.filter("location is not null").groupBy(by).agg(best.alias("best")).select(by, "best.*")


def merge_links(items: DataFrame, by: str = "cluster") -> DataFrame:
    """cluster, linkedin, github, portfolio, other.

    items: cluster, ord, slot (linkedin, github, portfolio, other), url. The first link of a slot stays; a later, different link of
    a filled slot is lost, as is an ``other`` that equals any slotted link; other links are kept once, in order."""
    given = items.withColumn("link", normalize_url(F.col("url"))).filter("link is not null")
    slots = given.filter("slot <> 'other'")
    first = slots.groupBy(by).pivot("slot", ["linkedin", "github", "portfolio"]).agg(F.min_by("url", "ord"))
    others = given.filter("slot = 'other'").join(slots.select(by, "link").distinct(), [by, "link"], "left_anti")
    others = others.groupBy(by, "link").agg(F.min(F.struct("ord", "url")).alias("at")).groupBy(by).agg(F.transform(F.sort_array(F.collect_list("at")), lambda x: x["url"]).alias("other"))
    out = given.select(by).distinct().join(first, by, "left").join(others, by, "left")
    return out.withColumn("other", F.coalesce("other", F.array().cast("array<string>")))


def rejected_values(competing: Column, selected: Column) -> Column:
    """Competing values that were not selected, repeats kept."""
    return F.filter(competing, lambda v: ~F.array_contains(selected, v))


#: What a field's merge is called where the settings don't say; the reasons of fields whose values are counted otherwise.
STRATEGIES = {"emails": "union", "phones": "union", "links": "union", "skills": "semantic_union", "experience": "chronological_merge", "education": "merge", "location": "most_complete", "years_experience": "maximum_verified", "headline": "highest_confidence"}
SEVERAL, ONE, ALIAS, LACKING = "strong_cross_source_agreement", "high_source_reliability", "semantic_alias_match", "missing_evidence"


def reason_of(field: str, competing: Column, selected: Column) -> Column:
    """Why a field has its value: skills and headlines are matched or missing; unions count what they selected, other fields what competed."""
    if field == "skills":
        return F.when(F.size(selected) > 0, ALIAS).otherwise(LACKING)
    if field == "headline":
        return F.when(F.size(selected) > 0, ONE).otherwise(LACKING)
    counted = selected if field in ("emails", "phones", "experience", "education") else competing
    return F.when(F.size(counted) > 1, SEVERAL).otherwise(ONE)


def merge_decisions(items: DataFrame, selected: DataFrame, field: str, by: str = "cluster", clusters: DataFrame | None = None, settings: Settings = DEFAULT, parts: int | None = None) -> DataFrame:
    """cluster, field, strategy, competing, selected, rejected, reason, confidence, one row a cluster that has values (each cluster of ``clusters``
    if given). items: cluster, ord, value; selected: cluster, value, and ``ord`` where the order of what was selected matters.

    parts: how many parts clusters are dealt over (``tables.shares`` of the items), which bounds what a task collects; by default as Spark sees fit, by bytes."""
    none = F.array().cast("array<string>")
    dealt = (lambda df: df.repartition(parts, by)) if parts else (lambda df: df)
    competing = dealt(items.filter("value is not null")).groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.col("value").cast("string").alias("value")))), lambda x: x["value"]).alias("competing"))
    place = F.col("ord") if "ord" in selected.columns else F.col("value").cast("string")
    chosen = dealt(selected.filter("value is not null")).groupBy(by).agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("at"), F.col("value").cast("string").alias("value")))), lambda x: x["value"])).alias("selected"))
    base = competing if clusters is None else clusters.select(by).distinct().join(competing, by, "left")
    out = base.join(chosen, by, "left").withColumns({"selected": F.coalesce("selected", none), "competing": F.coalesce("competing", none)})
    lists = field in ("emails", "phones", "skills", "experience", "education", "links")
    sure = F.lit(1.0) if lists else F.when(F.size("selected") > 0, 1.0).otherwise(0.0)
    return out.select(
        by, F.lit(field).alias("field"), F.lit(settings.policies.get(field, STRATEGIES.get(field, "highest_reliability"))).alias("strategy"), "competing", "selected", rejected_values(F.col("competing"), F.col("selected")).alias("rejected"),
        reason_of(field, F.col("competing"), F.col("selected")).alias("reason"), sure.alias("confidence"),
    )


# Folds


def _key(text: str | None) -> str | None:
    return " ".join((text or "").split()).lower() or None


def _longer(current: str | None, incoming: str | None) -> str | None:
    if not current or not incoming:
        return current or incoming
    return incoming if len(incoming) > len(current) else current


def _preferred(current: dict, incoming: dict, name: str) -> str | None:
    return incoming[f"{name}_canonical"] or current[f"{name}_canonical"] or _longer(current[name], incoming[name])


def _joined(left: str | None, right: str | None) -> str | None:
    parts = [" ".join(p.split()) for t in (left, right) if t for p in t.split(" | ")]
    return " | ".join(dict.fromkeys(p for p in parts if p)) or None


def _least(a, b):
    return min((x for x in (a, b) if x is not None), default=None)


def _most(a, b):
    return max((x for x in (a, b) if x is not None), default=None)


def overlap(a: dict, b: dict) -> bool:
    """Whether the periods may overlap; unknown bounds are open."""
    starts = a["start"] or a["end"], b["start"] or b["end"]
    return not (starts[0] and b["end"] and starts[0] > b["end"] or starts[1] and a["end"] and starts[1] > a["end"])


def same_place(a: dict | None, b: dict | None) -> bool:
    parts = ("city", "region", "country")
    shown = [_key(", ".join(x[p] for p in parts if x.get(p)) or x.get("raw")) if x else None for x in (a, b)]
    return bool(shown[0]) and shown[0] == shown[1]


def same_experience(a: dict, b: dict) -> bool:
    """One employer (by canonical or raw key) and a common title, period or description; or one title and period, and a common description or place."""
    company = any(a[k] and a[k] == b[k] for k in ("company_canonical_key", "company_key"))
    titles = [_key(x["title_canonical"] or x["title"]) for x in (a, b)]
    title, dates = bool(titles[0]) and titles[0] == titles[1], overlap(a, b)
    if company and (title or dates):
        return True
    if not company and not (title and dates):
        return False
    alike = sequence_ratio(a["summary"], b["summary"])
    return company and alike >= 0.82 or title and dates and (alike >= 0.70 or same_place(a["location"], b["location"]))


def first_experience(item: dict) -> dict:
    """An item that starts a merged one shows its canonical names, and is compared by them."""
    return {**item, **{n: item[f"{n}_canonical"] or item[n] for n in ("company", "title")}, "company_key": item["company_canonical_key"] or item["company_key"]}


def experience_keys(item: dict) -> list[tuple]:
    """What two items must have in common to be one: an employer's key, or a title."""
    keys = ("canonical", item["company_canonical_key"]), ("company", item["company_key"]), ("title", _key(item["title_canonical"] or item["title"]))
    return [k for k in keys if k[1]]


def add_experience(current: dict, new: dict) -> None:
    # the key is that of the name shown
    if new["company_canonical"] or current["company_canonical"]:
        current["company_key"] = (new if new["company_canonical"] else current)["company_canonical_key"]
    elif _longer(current["company"], new["company"]) != current["company"]:
        current["company_key"] = new["company_key"]
    for name in ("company", "title"):
        current[name] = _preferred(current, new, name)
        current[f"{name}_canonical"] = current[f"{name}_canonical"] or new[f"{name}_canonical"]
    current["company_canonical_key"] = current["company_canonical_key"] or new["company_canonical_key"]
    current["start"], current["end"] = _least(current["start"], new["start"]), _most(current["end"], new["end"])
    current["summary"] = _joined(current["summary"], new["summary"])
    if current["location"] and new["location"]:
        current["location"] = {k: v or new["location"][k] for k, v in current["location"].items()}
    current["location"] = current["location"] or new["location"]
    current["evidence_ids"] = list(dict.fromkeys([*(current["evidence_ids"] or ()), *(new["evidence_ids"] or ())]))
    current["confidence"] = max(current["confidence"], new["confidence"])


def experience_order(item: dict) -> tuple:
    return item["start"] is None, item["start"] or item["end"] or date.max


def same_education(a: dict, b: dict) -> bool:
    """One institution and a common degree, field or period."""
    if not _key(a["institution"]) or _key(a["institution"]) != _key(b["institution"]):
        return False
    degrees = [_key(x["degree_canonical"] or x["degree"]) for x in (a, b)]
    fields = [_key(x["field"]) for x in (a, b)]
    years = [(x["start_year"], x["end_year"]) for x in (a, b)]
    period = (None, None) in years or all(x is None or y is None or x == y for x, y in zip(*years, strict=True))
    return bool(degrees[0] and degrees[0] == degrees[1] or fields[0] and fields[0] == fields[1] or period)


def first_education(item: dict) -> dict:
    return {**item, "degree": item["degree_canonical"] or item["degree"]}


def education_keys(item: dict) -> list[tuple]:
    return [k] if (k := ("institution", _key(item["institution"])))[1] else []


def add_education(current: dict, new: dict) -> None:
    current["institution"] = _longer(current["institution"], new["institution"])
    current["degree"] = _preferred(current, new, "degree")
    current["degree_canonical"] = current["degree_canonical"] or new["degree_canonical"]
    current["field"] = current["field"] or new["field"]
    current["start_year"], current["end_year"] = _least(current["start_year"], new["start_year"]), _most(current["end_year"], new["end_year"])
    current["evidence_ids"] = list(dict.fromkeys([*(current["evidence_ids"] or ()), *(new["evidence_ids"] or ())]))
    current["confidence"] = max(current["confidence"], new["confidence"])


def education_order(item: dict) -> tuple:
    return item["end_year"] is None, -(item["end_year"] or 0), item["institution"] or "", item["degree"] or ""


def experience_rank(x: Column) -> Column:
    """experience_order as a Column."""
    return F.struct(x["start"].isNull().alias("open"), F.coalesce(x["start"], x["end"], F.lit(date.max)).alias("at"))


def education_rank(x: Column) -> Column:
    year = x["end_year"]
    return F.struct(year.isNull().alias("open"), (-F.coalesce(year, F.lit(0))).alias("at"), F.coalesce(x["institution"], F.lit("")).alias("a"), F.coalesce(x["degree"], F.lit("")).alias("b"))


def experience_links(x: Column) -> Column:
    """Keys by which an item, or what it is merged with, may meet others: employer under either of its keys, and title. A merged item's
    keys are always among those of its items."""
    key = lambda kind, value: F.when(value != "", F.concat(F.lit(kind), value))
    title = _bare(F.coalesce(blank_to_null(x["title_canonical"]), x["title"]))
    return F.array(key("c:", x["company_canonical_key"]), key("c:", x["company_key"]), key("t:", title))


def education_links(x: Column) -> Column:
    name = _bare(x["institution"])
    return F.array(F.when(name != "", name))


def _bare(text: Column) -> Column:
    """Lower-cased, without any white space: equal wherever _key is."""
    return F.regexp_replace(F.lower(text), r"(?U)[\s\x1c-\x1f]+", "")


@dataclass(frozen=True)
class Fold:
    """How items become merged ones: when two are the same, how one starts and how others join it, what they have in common if they are the same, and the order in the
    end; as Columns, all keys by which items can ever meet, and the same order."""

    same: Callable
    first: Callable
    add: Callable
    keys: Callable
    order: Callable
    links: Callable[[Column], Column]
    rank: Callable[[Column], Column]


EXPERIENCE = Fold(same_experience, first_experience, add_experience, experience_keys, experience_order, experience_links, experience_rank)
EDUCATION = Fold(same_education, first_education, add_education, education_keys, education_order, education_links, education_rank)
#: Items of a cluster from which on it is dealt over tasks by what its items have in common.
LARGE = 5_000


def merged_items(items: list[dict], fold: Fold) -> list[tuple[int, dict]]:
    """(place of its first item, merged item), in that order. Each item joins the first merged one that it matches, or starts one. Only merged items that share a key are compared."""
    merged: list[dict] = []
    places: list[int] = []
    at: dict[tuple, list[int]] = {}
    for n, item in enumerate(items):
        near = sorted({i for k in fold.keys(item) for i in at.get(k, ())})
        place = next((i for i in near if fold.same(merged[i], item)), None)
        if place is None:
            place = len(merged)
            merged.append(fold.first(dict(item)))
            places.append(n)
        else:
            fold.add(merged[place], item)
        for k in fold.keys(merged[place]):
            if place not in at.setdefault(k, []):
                at[k].append(place)
    return list(zip(places, merged, strict=True))


def fold_items(items: list[dict], fold: Fold) -> list[dict]:
    return sorted((m for _, m in merged_items(items, fold)), key=fold.order)


def _grouped(rows: DataFrame, by: list[str], out: str, make: Callable[[list], list]) -> DataFrame:
    """``by`` and an array of what ``make`` gives for the (ord, item) of each group, in order. rows: by, ord, item; a task streams its groups and holds one of them."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [rows.schema[c].dataType for c in by]
    arrow = [to_arrow_type(k) for k in kinds]
    made = pa.list_(pa.struct([("first", to_arrow_type(rows.schema["ord"].dataType)), ("item", to_arrow_type(rows.schema["item"].dataType))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done = None, [], []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * (len(by) + 1)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*arrow, made], strict=True)], [*by, out])

        for batch in batches:
            groups = zip(*(batch.column(c).to_pylist() for c in by), strict=True)
            for group, place, item in zip(groups, batch.column("ord").to_pylist(), batch.column("item").to_pylist(), strict=True):
                if group != now:
                    if held:
                        done.append((*now, make(held)))
                    now, held = group, []
                held.append((place, item))
            if done:
                yield packed()
                done.clear()
        if held:
            done.append((*now, make(held)))
        yield packed()

    shape = f"array<struct<first: {rows.schema['ord'].dataType.simpleString()}, item: {rows.schema['item'].dataType.simpleString()}>>"
    dealt = rows.select(*by, "ord", "item").repartition(*by).sortWithinPartitions(*by, "ord")
    return dealt.mapInArrow(run, ", ".join(f"{c} {k.simpleString()}" for c, k in zip(by, kinds, strict=True)) + f", {out} {shape}")


def _fold(items: DataFrame, name: str, fold: Fold, by: str) -> DataFrame:
    """cluster and an array of merged items. items: cluster, ord, item (struct).

    Clusters of fewer than LARGE items are folded by one task each. A larger one is parted first: items that share no key, not even by way of others, can
    never meet, so the components of its items and keys are folded apart, by as many tasks, and come together in the cluster's order. The result is that of one scan."""

    def folded(held: list) -> list[dict]:
        return [{"first": held[n][0], "item": m} for n, m in merged_items([x for _, x in held], fold)]

    def ordered(held: list) -> list[dict]:
        return sorted(folded(held), key=lambda m: fold.order(m["item"]))

    large = items.groupBy(by).count().filter(F.col("count") >= LARGE).select(by)
    tables = Tables(items.sparkSession, "fold")
    large = tables.table(large, "large")
    bare = lambda df: df.select(by, F.transform(name, lambda x: x["item"]).alias(name))
    if large.isEmpty():
        return bare(_grouped(items, [by], name, ordered))
    some = F.broadcast(large) if few(large, PARENTS) else large
    small = bare(_grouped(items.join(some, by, "left_anti"), [by], name, ordered))
    # nodes are hashes; should two be equal, two components are folded by one task
    big = tables.table(items.join(some, by, "left_semi").withColumn("node", F.xxhash64(by, F.lit("item"), "ord")), "items")
    edges = big.select(F.col("node").alias("a"), F.explode(F.array_compact(F.array_distinct(fold.links(F.col("item"))))).alias("key"), by)
    edges = tables.table(edges.select("a", F.xxhash64(by, F.lit("key"), "key").alias("b")), "edges")
    nodes = big.select("node").union(edges.select("b")).distinct()
    part = components(nodes, edges, tables)
    parted = _grouped(big.join(part, "node").select(by, F.col("label").alias("part"), "ord", "item"), [by, "part"], name, folded)
    each = parted.select(by, F.explode(name).alias("m")).select(by, F.struct(fold.rank(F.col("m.item")).alias("rank"), F.col("m.first").alias("first"), F.col("m.item").alias("item")).alias("m"))
    whole = each.groupBy(by).agg(F.transform(F.sort_array(F.collect_list("m")), lambda m: m["item"]).alias(name))
    return small.unionByName(whole)


def fold_experience(items: DataFrame, by: str = "cluster") -> DataFrame:
    return _fold(items, "experience", EXPERIENCE, by)


def fold_education(items: DataFrame, by: str = "cluster") -> DataFrame:
    return _fold(items, "education", EDUCATION, by)
