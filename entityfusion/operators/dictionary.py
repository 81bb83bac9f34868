"""Resolution of values against dictionaries: alias, canonical name, category, related entry, fuzzy match, unknown.

terms: domain, entry_ord, term_ord, term, term_key, is_alias, canonical, category, parent_category, related_to, metadata; a dictionary has some hundred
terms, and its size is checked before it is broadcast. Values are resolved once each, not once per occurrence; only those that no
exact stage knows are compared fuzzily."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy_index import TermIndex
from ..functions.text import company_key, repair_ocr_tokens, strip

TERMS = "domain string, entry_ord int, term_ord int, term string, term_key string, is_alias boolean, canonical string, category string, parent_category string, related_to array<string>, metadata map<string,string>"
#: Certainty of each stage.
STAGES = {"EXACT_ALIAS": 1.0, "CANONICAL_MATCH": 0.9, "PARENT_CATEGORY": 0.75, "ENTITY_LINKING": 0.7, "FUZZY_MATCH": 0.55, "UNKNOWN_VALUE": 0.2}
BROADCAST_TERMS = 20_000


def lookup_key(value: Column) -> Column:
    return F.lower(strip(value))


def index(terms: DataFrame, aliases: bool) -> DataFrame:
    """domain, key, canonical, category, parent_category, metadata: one row a key; of entries with equal keys the later wins."""
    of = terms.filter(F.col("is_alias") == aliases)
    last = F.max_by(F.struct("canonical", "category", "parent_category", "metadata"), F.struct("entry_ord", "term_ord"))
    return of.groupBy("domain", F.col("term_key").alias("key")).agg(last.alias("hit"))


def small(terms: DataFrame) -> DataFrame:
    """terms, broadcast if they are few."""
    return F.broadcast(terms) if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else terms


def alias_join(values: DataFrame, terms: DataFrame, aliases: bool = True, key: str = "key") -> DataFrame:
    """values with ``hit`` (struct, null where nothing matches): an equi-join on domain and key."""
    known = index(terms, aliases).withColumnRenamed("key", "_key").withColumnRenamed("domain", "_domain")
    return values.join(known, (F.col("domain") == F.col("_domain")) & (F.col(key) == F.col("_key")), "left").drop("_key", "_domain")


FUZZY = "canonical: string, category: string, parent_category: string, term: string, score: double"
#: Terms that a task compares a value with at once; more are dealt out in blocks.
BLOCK_TERMS = BROADCAST_TERMS


def fuzzy_best(values: DataFrame, terms: DataFrame, threshold: float = 90.0) -> DataFrame:
    """domain, value, fuzzy (canonical, category, parent_category, term, score): the best term of the domain in dictionary order, first best wins;
    null where none reaches the threshold. values: domain, value, distinct.

    Values meet their domain's terms in blocks of about BLOCK_TERMS terms: a block's terms come first and become an index, values stream by and are scored
    with those terms only whose bound reaches the threshold and the best score so far."""
    counted = terms.groupBy("domain").agg(F.ceil(F.count(F.lit(1)) / BLOCK_TERMS).alias("blocks"))
    text = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    place = F.struct("entry_ord", "is_alias", "term_ord")
    shown = ("canonical", "category", "parent_category")
    held = terms.join(counted, "domain").select("domain", F.pmod(F.xxhash64("term"), "blocks").alias("block"), F.lit(0).alias("kind"), place.alias("place"), "term", *shown, *text("value"))
    asked = values.select("domain", "value").join(counted, "domain").select("domain", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "value")
    # a value may be asked anywhere; several tasks share a block by holding its terms each
    shares = F.lit(max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")) // max(1, counted.count())))
    asked = asked.select("domain", "block", F.pmod(F.xxhash64("value"), shares).alias("share"), F.lit(1).alias("kind"), F.lit(None).cast(held.schema["place"].dataType).alias("place"), *text("term", *shown), "value")
    held = held.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)))
    rows = held.unionByName(asked).repartition("domain", "block", "share").sortWithinPartitions("domain", "block", "share", "kind", "place")
    kind = pa.struct([(n, pa.string()) for n in (*shown, "term")] + [("score", pa.float64())])
    where = pa.struct([("entry_ord", pa.int32()), ("is_alias", pa.bool_()), ("term_ord", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, index = None, [], None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if (r["domain"], r["block"], r["share"]) != now:
                    now, block, index = (r["domain"], r["block"], r["share"]), [], None
                if r["kind"] == 0:
                    block.append({n: r[n] for n in (*shown, "term", "place")})
                    continue
                index = index or TermIndex([t["term"] or "" for t in block])
                if (best := index.best(r["value"] or "", threshold)) is not None:
                    term = {**block[best[0]], "score": best[1]}
                    out.append((r["domain"], r["value"], term.pop("place"), term))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), where, kind), strict=True)], ["domain", "value", "place", "fuzzy"])

    found = rows.mapInArrow(run, f"domain string, value string, place struct<entry_ord: int, is_alias: boolean, term_ord: int>, fuzzy struct<{FUZZY}>")
    first = F.struct(F.col("fuzzy.score"), -F.col("place.entry_ord"), ~F.col("place.is_alias"), -F.col("place.term_ord"))
    best = found.groupBy("domain", "value").agg(F.max_by("fuzzy", first).alias("fuzzy"))
    return values.select("domain", "value").join(best, ["domain", "value"], "left")


def resolve(values: DataFrame, terms: DataFrame, threshold: float = 90.0, category_stages: bool = False) -> DataFrame:
    """domain, value, canonical, category, parent_category, stage, score, metadata for each distinct (domain, value).

    Skills, job titles and degrees are repaired first, companies get their words apart. ``category_stages`` adds the
    stages by category and by related entry."""
    given = values.select("domain", "value").filter("value is not null").distinct()
    repaired = F.when(F.col("domain") == "companies", company_key(F.col("value"))).otherwise(repair_ocr_tokens(F.col("value")))
    given = given.withColumn("clean", F.coalesce(repaired, "value")).withColumn("key", lookup_key(F.col("clean")))
    terms = small(terms)
    met = alias_join(given, terms).withColumnRenamed("hit", "by_alias")
    met = alias_join(met, terms, aliases=False).withColumnRenamed("hit", "by_name")
    hit = F.coalesce("by_alias", "by_name")
    stage = F.when(F.col("by_alias").isNotNull(), "EXACT_ALIAS").when(F.col("by_name").isNotNull(), "CANONICAL_MATCH")
    # outside skills a name that is the canonical one is canonical however it was found
    named = (F.col("domain") != "skills") & (F.lower(hit["canonical"]) == F.col("key"))
    met = met.select("domain", "value", "clean", "key", hit.alias("hit"), F.when(named, "CANONICAL_MATCH").otherwise(stage).alias("stage"))
    if category_stages:
        met = _by_category(met, terms)
    open_ = met.filter("stage is null").select("domain", F.col("clean").alias("value")).distinct()
    near = fuzzy_best(open_, terms, threshold).withColumnRenamed("value", "clean")
    met = met.join(near, ["domain", "clean"], "left")
    stage = F.coalesce("stage", F.when(F.col("fuzzy").isNotNull(), "FUZZY_MATCH"), F.lit("UNKNOWN_VALUE"))
    known = F.coalesce("hit.canonical", "fuzzy.canonical")
    score = F.create_map(*(F.lit(x) for kv in STAGES.items() for x in kv))
    return met.select(
        "domain", "value", known.alias("canonical"), F.coalesce("hit.category", "fuzzy.category").alias("category"),
        F.coalesce("hit.parent_category", "fuzzy.parent_category").alias("parent_category"), stage.alias("stage"), score[stage].alias("score"), F.col("hit.metadata").alias("metadata"),
    )


def _by_category(met: DataFrame, terms: DataFrame) -> DataFrame:
    entries = terms.filter(~F.col("is_alias"))
    shape = F.struct("canonical", "category", "parent_category", "metadata")
    first = lambda df, key: df.groupBy("domain", key.alias("key")).agg(F.min_by(shape, "entry_ord").alias("found"))
    for df, key, stage in (
        (entries, lookup_key(F.col("category")), "PARENT_CATEGORY"),
        (entries.withColumn("related", F.explode("related_to")), lookup_key(F.col("related")), "ENTITY_LINKING"),
    ):
        met = met.join(first(df, key), ["domain", "key"], "left")
        new = F.when(F.col("stage").isNull() & F.col("found").isNotNull(), stage)
        met = met.select("domain", "value", "clean", "key", F.coalesce("hit", "found").alias("hit"), F.coalesce("stage", new).alias("stage"))
    return met


def resolve_country(values: DataFrame, terms: DataFrame) -> DataFrame:
    """value, country, country_code: exact matches only; the code is the dictionary's, or the name where it has none."""
    given = values.select("value").distinct().withColumn("domain", F.lit("countries")).withColumn("key", lookup_key(F.col("value")))
    met = alias_join(given, small(terms)).withColumnRenamed("hit", "by_alias")
    met = alias_join(met, terms, aliases=False)
    hit = F.coalesce("by_alias", "hit")
    return met.select("value", hit["canonical"].alias("country"), F.coalesce(hit["metadata"]["iso2"], hit["canonical"]).alias("country_code"))


def categories(terms: DataFrame, domain: str) -> DataFrame:
    """The distinct categories of a domain, sorted."""
    return terms.filter(F.col("domain") == domain).select("category").filter("category is not null").distinct().orderBy("category")


def related(terms: DataFrame, domain: str, name: str) -> DataFrame:
    """Entries that an entry is related to."""
    of = terms.filter((F.col("domain") == domain) & ~F.col("is_alias") & (F.col("term_key") == name.strip().lower()))
    return of.select(F.explode("related_to").alias("related"))


def check(terms: DataFrame) -> DataFrame:
    """Problems of a dictionary: entries without name or category; keys that several entries claim."""
    nameless = terms.filter("canonical is null or canonical = '' or category is null or category = ''").select("domain", F.coalesce("term", F.lit("")).alias("term"), F.lit("incomplete_entry").alias("problem"))
    several = Window.partitionBy("domain", "term_key")
    claimed = terms.filter("is_alias").withColumn("n", F.size(F.collect_set("entry_ord").over(several))).filter("n > 1")
    return nameless.union(claimed.select("domain", "term", F.lit("ambiguous_alias"))).distinct()
