"""From fragments to validated output, as one plan: resolve, identify, fuse, audit, score, project, validate.

Values live in long tables keyed by cluster with ordinals; nested records are put together at the end, once."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, company_key, stable_id, strip
from ..functions.values import location_string
from ..operators import confidence, dictionary, evidence, fusion, identity, projection, report, validation
from ..settings import DEFAULT, Settings
from .tables import Tables

LOG = logging.getLogger(__name__)
#: More than the places of a fragment's list times those of a piece of evidence's parts, and than those parts: no array has more than 2^31. Ordinals
#: are whole decimals, so 2^63 fragments have their own.
PARTS = 1 << 31
ITEMS = PARTS << 31
STORED = "frag_id string, at int, field string, original string, canonical string, source string, method string, rule string, confidence double, record_id string"


@dataclass
class Result:
    clusters: DataFrame
    canonical: DataFrame
    fields: DataFrame
    provenance: DataFrame
    transformations: DataFrame
    decisions: DataFrame
    projected: DataFrame
    issues: DataFrame
    summary: DataFrame
    tables: Tables

    def close(self) -> None:
        """Removes the written tables that the frames above read: for when all that is wanted of them is written elsewhere."""
        self.tables.close()


def ordinal(fragment: Column, at: Column | None = None, part: Column | None = None) -> Column:
    """Where something stands: fragment, place in its list, part of that."""
    whole = lambda c: F.lit(0) if c is None else c
    number = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    return (fragment.cast("decimal(19,0)") * number(ITEMS) + whole(at).cast("decimal(10,0)") * number(PARTS) + whole(part)).cast("decimal(38,0)")


def items(fragments: DataFrame, column: str) -> DataFrame:
    """frag_id, ord, source, quality, item: a list's items in input order."""
    return fragments.select("frag_id", "source", "quality", "frag_ord", F.posexplode(column).alias("at", "item")).select("frag_id", "source", "quality", ordinal(F.col("frag_ord"), F.col("at")).alias("ord"), "item")


def resolved(rows: DataFrame, value: Column, domain: str, found: DataFrame, prefix: str) -> DataFrame:
    """rows with the resolution of ``value`` as a struct ``prefix``."""
    of = found.filter(F.col("domain") == domain).select(F.col("value").alias("_value"), F.struct("canonical", "category", "parent_category", "stage", "score").alias(prefix))
    return rows.withColumn("_v", value).join(of, F.col("_v") == F.col("_value"), "left").drop("_v", "_value")


def told_skills(fragments: DataFrame) -> DataFrame:
    """Skills as items: those that a fragment's evidence tells, parted by commas; the fragment's own list where no evidence tells any."""
    pieces = items(fragments, "evidence").filter(F.lower("item.field").contains("skill") & F.col("item.original").isNotNull())
    parts = F.filter(F.transform(F.split("item.original", ","), strip), lambda t: t != "")
    parts = pieces.select("frag_id", "source", "quality", "ord", F.col("item.evidence_id").alias("id"), F.posexplode(parts).alias("part", "name"))
    null = F.lit(None).cast("string")
    item = F.struct(F.col("name"), F.array("name").alias("original_names"), null.alias("category"), null.alias("parent_category"), F.lit(1.0).alias("confidence"), F.array("source").alias("sources"), F.array("id").alias("evidence_ids"))
    made = parts.select("frag_id", "source", "quality", (F.col("ord") + F.col("part")).cast("decimal(38,0)").alias("ord"), item.alias("item"))
    return made.unionByName(items(fragments, "skills").join(made.select("frag_id").distinct(), "frag_id", "left_anti"))


def competing_and_selected(fragments: DataFrame, lists: dict[str, DataFrame], fused: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Field -> (cluster, ord, value that competed; cluster, value that was selected), in the order in which fields are merged.

    lists: cluster, ord, item of emails, phones, skills, experience, education. fused: cluster and the merged column of each field."""
    shown = lambda *parts: F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))
    item = lambda c: F.col(f"item.{c}")
    values = {
        "emails": item("normalized"), "phones": F.coalesce(item("e164"), item("raw")), "skills": item("name"),
        "experience": shown(F.coalesce(item("company_canonical"), item("company")), F.coalesce(item("title_canonical"), item("title")), item("start"), item("end")),
        "education": shown(item("institution"), F.coalesce(item("degree_canonical"), item("degree")), item("field"), item("start_year"), item("end_year")),
    }
    chosen = {"emails": lambda x: x["normalized"], "phones": lambda x: x["e164"], "skills": lambda x: x["name"], "experience": lambda x: F.to_json(x), "education": lambda x: F.to_json(x)}
    each = lambda df, array: df.select("cluster", F.posexplode(array).alias("ord", "value"))
    place, links = fused["location"], fused["links"]
    whole = F.array(*(F.col(f"location.{c}") for c in ("raw", "city", "region", "country", "country_code")))
    slots = lambda prefix: F.array(*(F.col(f"{prefix}.{c}") for c in ("linkedin", "github", "portfolio")))
    one = lambda c: (fragments.select("cluster", "ord", F.col(c).alias("value")), fused[c].select("cluster", F.col(c).alias("value")))
    out = {f: (lists[f].select("cluster", "ord", v.alias("value")), each(fused[f], F.transform(f, chosen[f]))) for f, v in values.items()}
    out["links"] = (fragments.select("cluster", "ord", F.posexplode(slots("links")).alias("at", "value")).select("cluster", (F.col("ord") + F.col("at")).cast("decimal(38,0)").alias("ord"), "value"), each(links, slots("links")))
    string = location_string(F.col("location.city"), F.col("location.region"), F.col("location.country"))
    out["location"] = (fragments.filter("location is not null").select("cluster", "ord", F.coalesce(blank_to_null(F.col("location.raw")), string, F.lit("")).alias("value")), each(place, whole))
    out |= {c: one(c) for c in ("years_experience", "headline")}
    return {f: out[f] for f in ("emails", "phones", "links", "skills", "experience", "education", "location", "years_experience", "headline")}


def run(fragments: DataFrame, terms: DataFrame, config: projection.Config = projection.Config(), threshold: float = 90.0, settings: Settings = DEFAULT, stored: DataFrame | None = None) -> Result:  # noqa: B008
    """fragments: ``schemas.FRAGMENT``, from any sources, with frag_ord over all of them. stored: STORED, provenance that fragments bring with them; it comes
    first in the trail, before that of evidence and of merge decisions."""
    spark = fragments.sparkSession
    tables = Tables(spark, "fusion")
    LOG.info("fusion begins, tables in %s", tables.root)
    fragments = tables.table(fragments)
    # values and their resolution
    skills, jobs, study = told_skills(fragments), items(fragments, "experience"), items(fragments, "education")
    text = lambda df, domain, value: df.select(F.lit(domain).alias("domain"), value.alias("value"))
    wanted = [
        text(skills, "skills", F.col("item.name")), text(jobs, "companies", F.col("item.company")), text(jobs, "job_titles", F.col("item.title")), text(study, "degrees", F.col("item.degree")),
    ]
    found = tables.table(dictionary.resolve(reduce(DataFrame.union, wanted).filter("value <> ''"), terms, threshold))
    places = fragments.filter("location.country is not null").select(F.col("location.country").alias("value"))
    countries = dictionary.resolve_country(places, terms)
    skills = tables.table(resolved(skills, F.col("item.name"), "skills", found, "r"))
    jobs = tables.table(resolved(resolved(jobs, F.col("item.company"), "companies", found, "company"), F.col("item.title"), "job_titles", found, "title"))
    study = tables.table(resolved(study, F.col("item.degree"), "degrees", found, "degree"))
    code = F.coalesce("location.country_code", "found_code")
    located = fragments.join(countries.select(F.col("value").alias("_country"), F.col("country").alias("found_country"), F.col("country_code").alias("found_code")), F.col("location.country") == F.col("_country"), "left")
    located = located.withColumn("location", F.when(F.col("location").isNotNull(), F.struct("location.raw", "location.city", "location.region", F.coalesce("found_country", "location.country").alias("country"), code.alias("country_code"))))
    fragments = tables.table(located.drop("_country", "found_country", "found_code"))
    # identity
    keys = tables.table(identity.identity_keys(fragments, settings.case_insensitive))
    clusters = tables.table(identity.greedy_clusters(fragments, keys, tables))
    of = clusters.select("frag_id", F.col("cluster_ord").alias("cluster"))
    fragments = tables.table(fragments.join(of, "frag_id").withColumn("ord", ordinal(F.col("frag_ord"))))
    skills, jobs, study = (df.join(of, "frag_id") for df in (skills, jobs, study))
    # fusion
    trust = lambda field=None: fusion.reliability(F.col("source"), field, settings)
    name = fusion.best_by_reliability(fragments, "full_name", trust())
    headline = fusion.best_by_reliability(fragments, "headline", trust())
    years = fusion.max_verified(fragments, "years_experience", trust()).select("cluster", "years_experience")
    place = fusion.most_complete(fragments, trust()).select("cluster", "location")
    ids = fragments.groupBy("cluster").agg(F.min_by("external_id", "frag_ord").alias("external_id"))

    def contact(column: str, key: str, other: str) -> DataFrame:
        rows = items(fragments, column).join(of, "frag_id").select("cluster", "ord", "source", "item.*").withColumn("key", F.coalesce(key, other))
        made = fusion.union_values(rows, "key", F.greatest(F.col("confidence"), trust(column)), (other, key), ("evidence_ids",))
        shape = F.struct("ord", F.struct(F.col(other), F.col(key), "confidence", "evidence_ids").alias("v"))
        return made.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(shape)), lambda x: x["v"]).alias(column))

    emails, phones = contact("emails", "normalized", "value"), contact("phones", "e164", "raw")
    slot = lambda i, s, url: F.struct(F.lit(i).alias("i"), F.lit(s).alias("slot"), url.alias("url"))
    slots = F.concat(F.array(*(slot(i, s, F.col(f"links.{s}")) for i, s in enumerate(("linkedin", "github", "portfolio")))), F.transform(F.coalesce("links.other", F.array().cast("array<string>")), lambda u, i: F.struct((i + 3).alias("i"), F.lit("other").alias("slot"), u.alias("url"))))
    urls = fragments.select("cluster", "ord", F.inline(slots)).select("cluster", (F.col("ord") + F.col("i")).cast("decimal(38,0)").alias("ord"), "slot", "url")
    links = fusion.merge_links(urls).select("cluster", F.struct("linkedin", "github", "portfolio", "other").alias("links"))
    known = skills.select(
        "cluster", "ord", "source", F.coalesce("r.canonical", "item.name").alias("name"), F.col("item.original_names").alias("original_names"), F.coalesce("r.category", "item.category").alias("category"), F.coalesce("r.parent_category", "item.parent_category").alias("parent_category"),
        F.when(F.col("r.canonical").isNotNull(), 1.0).otherwise(F.when(F.col("r.stage") == "UNKNOWN_VALUE", 0.0).otherwise(F.col("item.confidence"))).alias("confidence"), F.col("item.sources").alias("sources"), F.col("item.evidence_ids").alias("evidence_ids"),
    ).withColumn("key", F.lower("name"))
    united = fusion.union_values(known, "key", F.greatest(F.col("confidence"), trust("skills")), ("name", "category", "parent_category"), ("original_names", "sources", "evidence_ids"))
    shape = F.struct("ord", F.struct("name", "original_names", "category", "parent_category", "confidence", "sources", "evidence_ids").alias("v"))
    united = united.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(shape)), lambda x: x["v"]).alias("skills"))
    job = jobs.select("cluster", "ord", F.col("item").withField("company_canonical", F.col("company.canonical")).withField("title_canonical", F.col("title.canonical")).withField("confidence", F.greatest("item.confidence", trust("experience"))).alias("item"))
    job = job.withColumn("item", F.col("item").withField("company_key", company_key(F.col("item.company"))).withField("company_canonical_key", company_key(F.col("item.company_canonical"))))
    experience = fusion.fold_experience(job).select("cluster", F.transform("experience", lambda x: x.dropFields("company_key", "company_canonical_key")).alias("experience"))
    degree = study.select("cluster", "ord", F.col("item").withField("degree_canonical", F.col("degree.canonical")).withField("confidence", F.greatest("item.confidence", trust("education"))).alias("item"))
    education = fusion.fold_education(degree)
    # audit
    records = fragments.select("frag_id", "record_id")
    told = items(fragments, "evidence").join(of, "frag_id").join(records, "frag_id").select("cluster", "ord", "source", "quality", "record_id", "item.*")
    told = tables.table(evidence.dedupe_last(told, "evidence_id"))
    change = lambda df, r, field, value: df.filter(F.col(r).isNotNull()).select("cluster", "ord", F.lit(field).alias("field"), value.alias("original"), F.col(f"{r}.canonical").alias("canonical"), F.col(f"{r}.stage").alias("stage"))
    changes = told.select("cluster", "ord", "field", "original", "canonical", F.lit("UNKNOWN_VALUE").alias("stage"))
    for part in (change(skills, "r", "skills", F.col("item.name")), change(jobs, "company", "company", F.col("item.company")), change(jobs, "title", "job_title", F.col("item.title")), change(study, "degree", "degree", F.col("item.degree"))):
        changes = changes.unionByName(part)
    summaries = evidence.source_summaries(fragments.select("cluster", "ord", "source", "record_id", "source_file", "quality"))
    emailed, phoned = (items(fragments, c).join(of, "frag_id") for c in ("emails", "phones"))
    called = skills.withColumn("item", F.struct(F.coalesce("r.canonical", "item.name").alias("name")))
    lists = {"emails": emailed, "phones": phoned, "skills": called, "experience": job, "education": degree}
    fused = {"emails": emails, "phones": phones, "skills": united, "experience": experience, "education": education, "links": links, "location": place, "years_experience": years, "headline": headline}
    made = [
        fusion.merge_decisions(*both, field, clusters=ids, settings=settings).withColumn("ord", F.lit(i)) for i, (field, both) in enumerate(competing_and_selected(fragments, lists, fused).items())
    ]
    decisions = tables.table(reduce(DataFrame.unionByName, made))
    if stored is None:
        stored = spark.createDataFrame([], STORED)
    brought = stored.join(fragments.select("frag_id", "frag_ord", "cluster"), "frag_id").withColumn("ord", ordinal(F.col("frag_ord"), F.col("at")))
    trail = evidence.compact_provenance(evidence.distinct_provenance(evidence.enrich(brought, told, decisions)))
    # confidence
    scored = told.withColumn("value", F.coalesce("canonical", "original"))
    listed = lambda df, field, value: df.select("cluster", F.lit(field).alias("field"), value.cast("string").alias("value"))
    values = scored.select("cluster", "field", "value")
    for part in (listed(skills, "skills", F.col("item.name")), listed(jobs, "experience", F.to_json("item")), listed(study, "education", F.to_json("item"))):
        values = values.union(part)
    # evidence that merged items name counts for their field too
    named = [df.select("cluster", F.lit(c).alias("field"), F.explode(F.flatten(F.transform(c, lambda x: x["evidence_ids"]))).alias("evidence_id")) for df, c in ((united, "skills"), (experience, "experience"), (education, "education"))]
    named = reduce(DataFrame.union, named).join(told.select("cluster", "evidence_id", "source", "quality"), ["cluster", "evidence_id"])
    seen = scored.select("cluster", "field", "source", "quality").unionByName(named.select("cluster", "field", "source", "quality"))
    fields = tables.table(confidence.field_confidence(ids, seen, values, changes, summaries, settings))
    overall = confidence.overall_confidence(fields, settings=settings)
    # records
    parts = (name, emails, phones, place, links, headline, years, united, experience, education, overall.withColumnRenamed("overall", "overall_confidence"))
    record = reduce(lambda a, b: a.join(b, "cluster", "left"), parts, ids)
    listed_trail = trail.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.struct("field", "source", "method", "rule", "original", "canonical", "confidence", "record_ids").alias("v")))), lambda x: x["v"]).alias("provenance"))
    # an entity whose first fragment names none gets an id of its name, first contacts and all its fragments
    nameless = ids.filter(F.coalesce("external_id", F.lit("")) == "").select("cluster")
    members = fragments.select("cluster", "frag_ord", "frag_id").join(nameless, "cluster", "left_semi").groupBy("cluster")
    members = members.agg(F.transform(F.sort_array(F.collect_list(F.struct("frag_ord", "frag_id"))), lambda x: x["frag_id"]).alias("frag_ids"))
    own = stable_id(F.col("full_name"), F.get("emails", F.lit(0))["normalized"], F.get("phones", F.lit(0))["e164"], F.array_join("frag_ids", "::"))
    record = record.join(listed_trail, "cluster", "left").join(members, "cluster", "left").withColumn("candidate_id", F.coalesce(blank_to_null(F.col("external_id")), own))
    for c in ("emails", "phones", "skills", "experience", "education"):
        record = record.withColumn(c, F.coalesce(c, F.array().cast(record.schema[c].dataType)))
    order = ("candidate_id", "full_name", "emails", "phones", "location", "links", "headline", "years_experience", "skills", "experience", "education", "provenance", "overall_confidence", "cluster")
    canonical = tables.table(validation.finalized(record.select(*order)))
    projected = projection.project(canonical.drop("cluster"), config)
    issues = validation.validate(projected, config)
    summary = report.run_summary(canonical, validation.validity(canonical.select("candidate_id"), issues))
    LOG.info("fusion is planned")
    return Result(clusters, canonical, fields, trail, changes, decisions, projected, issues, summary, tables)
