"""Entity resolution by prioritised identity keys.

Greedy clusters follow input order: a fragment joins the cluster of its first known key, else founds one; then all of its keys
point at that cluster, whatever they pointed at before; clusters never merge. So a key points at the cluster of the latest earlier
fragment that has it, and a fragment follows that of its first key which any earlier one has: parents in a forest, found
by one sort of the keys and led to their roots by pointer jumping. ``connected`` takes the components of fragments and keys instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, normalize_whitespace
from ..functions.text import text_key as lower_key
from ..functions.values import normalize_email, normalize_url
from ..plans.tables import Tables, components, roots

#: Keys in order of priority, and the confidence of a match by each.
CONFIDENCE = {"linkedin_url": 1.0, "email": 0.98, "phone": 0.96, "github_url": 0.94, "full_name": 0.90, "full_name_country": 0.88, "full_name_city": 0.86}
NEW = "different_candidates"
KEYS = "frag_id string, frag_ord bigint, key_ord int, priority int, key string, value string"


def identity_keys(fragments: DataFrame, case_insensitive: bool = True, keyless: bool = False) -> DataFrame:
    """frag_id, frag_ord, key_ord, priority, key, value: the keys of each fragment in the order in which they are tried.

    With ``keyless``, a fragment that has none is one row with a null key (and as value one of 1,024 shares, over which such rows are spread)."""
    text_key = lower_key if case_insensitive else lambda value: blank_to_null(normalize_whitespace(value))
    one = lambda key, value: F.array(F.struct(F.lit(key).alias("key"), value.alias("value")))
    name = text_key(F.col("full_name"))
    country = text_key(F.coalesce("location.country_code", "location.country"))
    city = text_key(F.col("location.city"))
    each = lambda key, items: F.transform(items, lambda v: F.struct(F.lit(key).alias("key"), v.alias("value")))
    emails = F.transform("emails", lambda e: normalize_email(F.coalesce(e["normalized"], e["value"])))
    phones = F.transform("phones", lambda p: F.regexp_replace(F.coalesce(p["e164"], p["raw"]), r"[^0-9+]", ""))
    keys = F.concat(
        one("linkedin_url", normalize_url(F.col("links.linkedin"))),
        each("email", F.coalesce(emails, F.array().cast("array<string>"))),
        each("phone", F.coalesce(phones, F.array().cast("array<string>"))),
        one("github_url", normalize_url(F.col("links.github"))),
        one("full_name", name),
        one("full_name_country", F.concat(name, F.lit("|"), country)),
        one("full_name_city", F.concat(name, F.lit("|"), city)),
    )
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(CONFIDENCE) for x in (k, i)))
    keys = F.filter(keys, lambda k: k["value"].isNotNull() & (k["value"] != ""))
    if keyless:
        keys = F.when(F.size(keys) > 0, keys).otherwise(one(F.lit(None).cast("string"), F.pmod(F.xxhash64("frag_id"), F.lit(1024)).cast("string")))
    rows = fragments.select("frag_id", "frag_ord", F.posexplode(keys).alias("key_ord", "k"))
    return rows.select("frag_id", "frag_ord", "key_ord", rank[F.col("k.key")].alias("priority"), F.col("k.key").alias("key"), F.col("k.value").alias("value"))


def connected(fragments: DataFrame, keys: DataFrame, tables: Tables) -> DataFrame:
    """frag_ord, component (the least frag_ord of its component)."""
    hubs = keys.groupBy("key", "value").agg(F.min("frag_ord").alias("hub"))
    edges = keys.join(hubs, ["key", "value"]).select(F.col("frag_ord").alias("a"), F.col("hub").alias("b")).filter("a <> b").distinct()
    return components(fragments.select(F.col("frag_ord").alias("node")), edges, tables).select(F.col("node").alias("frag_ord"), F.col("label").alias("component"))


def earlier(keys: DataFrame, tables: Tables) -> DataFrame:
    """frag_ord, key_ord, priority, parent: for each key of a fragment the latest earlier fragment that has it too, if any does.

    Keys are sorted by ranges, so a key of many fragments lies over several; the last row of each range is known to the next."""
    once = keys.groupBy("key", "value", "frag_ord").agg(F.min("key_ord").alias("key_ord"), F.min("priority").alias("priority"))
    met = with_previous(once, ("key", "value", "frag_ord"), ["key", "value"], tables)
    return met.filter("previous is not null").select("frag_ord", "key_ord", "priority", F.col("previous.frag_ord").alias("parent"))


def with_previous(rows: DataFrame, order: tuple[str, ...], by: list[str], tables: Tables) -> DataFrame:
    """rows with ``previous``: the columns of ``order`` of the row before, where that has the same ``by``; null for the first. ``by`` begins ``order``."""
    rows = tables.table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "keys")
    own = F.struct(*order)
    last = rows.groupBy("part").agg(F.max(own).alias("last"))  # one row a range
    last = last.select("part", F.lag("last").over(Window.orderBy("part")).alias("before"))
    met = rows.join(F.broadcast(last), "part").withColumn("prev", F.coalesce(F.lag(own).over(Window.partitionBy("part").orderBy(*order)), "before"))
    same = F.lit(True)
    for c in by:
        same = same & (F.col("prev")[c] == F.col(c))
    return met.withColumn("previous", F.when(same, F.col("prev"))).drop("part", "before", "prev")


def match_by(best: Column) -> list[Column]:
    """key_used, confidence, reason of a cluster, by the priority of its best match (null: none)."""
    used = F.create_map(*(F.lit(x) for i, k in enumerate(CONFIDENCE) for x in (i, k)))
    sure = F.create_map(*(F.lit(x) for i, k in enumerate(CONFIDENCE) for x in (i, CONFIDENCE[k])))
    key = F.coalesce(used[best], F.lit(NEW))
    reason = F.when(best.isNull(), "No deterministic identity key matched").otherwise(F.concat(F.lit("Matched by "), key))
    return [key.alias("key_used"), F.coalesce(sure[best], F.lit(0.0)).alias("confidence"), reason.alias("reason")]


def greedy_clusters(fragments: DataFrame, keys: DataFrame, tables: Tables) -> DataFrame:
    """cluster_ord, frag_id, frag_ord, key_used, confidence, reason, evidence; the key and confidence are the best of the cluster's matches."""
    first = F.min_by(F.struct("priority", "parent"), "key_ord")
    matches = tables.table(earlier(keys, tables).groupBy("frag_ord").agg(first.alias("m")).select("frag_ord", "m.priority", "m.parent"), "matches")
    above = roots(tables.table(matches.select(F.col("frag_ord").alias("node"), F.col("parent").alias("up")), "parents"), tables)
    led = matches.join(above, F.col("frag_ord") == F.col("node")).select("frag_ord", "priority", F.col("up").alias("cluster"))
    found = tables.table(fragments.select("frag_ord").join(led, "frag_ord", "left").select(F.coalesce("cluster", "frag_ord").alias("cluster"), "priority", "frag_ord"), "clusters")
    best = found.groupBy("cluster").agg(F.min("priority").alias("best"))
    labels = {"linkedin_url": "linkedin", "github_url": "github"}
    label = F.create_map(*(F.lit(x) for k in CONFIDENCE for x in (k, labels.get(k, k))))
    proof = keys.join(found.select("cluster", "frag_ord"), "frag_ord").groupBy("cluster", "key", "value").agg(F.min(F.struct("frag_ord", "key_ord")).alias("at"))
    proof = proof.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.concat(label[F.col("key")], F.lit(":"), F.col("value")).alias("text")))), lambda x: x["text"]).alias("evidence"))
    out = found.join(best, "cluster").join(fragments.select("frag_ord", "frag_id"), "frag_ord").join(proof, "cluster", "left")
    return out.select(F.col("cluster").alias("cluster_ord"), "frag_id", "frag_ord", *match_by(F.col("best")), "evidence")
