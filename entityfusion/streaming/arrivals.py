"""Greedy identity as fragments arrive: a new fragment joins its cluster, and nothing that came before is worked out again.

The order is that of arrival: batch by batch, within a batch by (frag_ord, frag_id). The result is that of ``identity.greedy_clusters`` over all fragments in
that order; a cluster bears the frag_id of the fragment that founded it. State is a table of the latest fragment of each identity key, to which a batch adds its own keys' rows;
a batch scans it once, natively and without sorting it where its keys are few. Each batch then follows parents inside itself to their roots, and looks up the clusters of those earlier fragments that the roots follow: the table of clusters
is partitioned by ``span`` of frag_ord, so only the spans with such a fragment are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import identity
from ..plans.tables import PARENTS, Tables, few, roots

MET = "frag_id string, frag_ord bigint, key_ord int, priority int, parent string, parent_ord bigint, inside boolean"
CLUSTERS = "frag_id string, frag_ord bigint, cluster string, priority int, batch int, span bigint"
#: Values of frag_ord that share a folder of the clusters' table: an hour, where frag_ord is a time in microseconds.
SPAN = 3_600_000_000
#: Spans up to which a batch names those it reads.
SPANS = 1000
#: Rows of a batch's spans that share a file, and the most files of a span.
SHARE, SHARES = 100_000, 16
LATEST = "key string, value string, frag_id string, frag_ord bigint, batch int"


def met(batch: DataFrame, n: int, path: str, tables: Tables, within: int | None = None) -> DataFrame:
    """MET of batch ``n`` (``identity.KEYS``): for each fragment that has a key, the fragment that had it before, in this batch (``inside``) or in an earlier one.
    Its latest fragment of each key goes to a folder of its own of the table at ``path``.

    Rows are sorted by ranges (``earlier``), so a hot key lies over many tasks; only a key's first row asks what earlier batches had, and few keys are told to the table's
    readers rather than shuffled with it. ``within``: a key leads to the fragment that had it before only if frag_ord has grown by this at most since (always, by default);
    its row stays, so that a run tells the same however its batches were cut."""
    none = {"parent": F.lit(None).cast("string"), "parent_ord": F.lit(None).cast("bigint"), "inside": F.lit(False)}
    by = ["key", "value"]
    once = batch.filter("key is not null").groupBy(*by, "frag_ord", "frag_id").agg(F.min("key_ord").alias("key_ord"), F.min("priority").alias("priority"))
    rows = tables.table(identity.with_previous(once, (*by, "frag_ord", "frag_id"), by, tables), "keyed")
    first = tables.table(rows.filter("previous is null"), "first_of_keys")
    known = latest(batch.sparkSession, path).filter(F.col("batch") < n) if n else None
    if known is not None:
        wanted = first.select(*by)
        asked = known.join(F.broadcast(wanted) if few(wanted, PARENTS) else wanted, by, "left_semi").groupBy(*by).agg(F.max(F.struct("batch", "frag_ord", "frag_id")).alias("at"))
        asked = tables.table(asked.select(*by, F.col("at.frag_id").alias("parent"), F.col("at.frag_ord").alias("parent_ord")), "asked")
        first = first.join(F.broadcast(asked) if few(asked, PARENTS) else asked, by, "left")
    else:
        first = first.withColumns({c: none[c] for c in ("parent", "parent_ord")})
    last = rows.groupBy(*by).agg(F.max(F.struct("frag_ord", "frag_id")).alias("at")).select(*by, "at.frag_id", "at.frag_ord")
    last.write.mode("overwrite").parquet(f"{path}/batch={n}")
    columns = ["frag_id", "frag_ord", "key_ord", "priority", "parent", "parent_ord", "inside"]
    later = rows.filter("previous is not null").withColumns({"parent": F.col("previous.frag_id"), "parent_ord": F.col("previous.frag_ord"), "inside": F.lit(True)})
    out = later.select(*columns).unionByName(first.withColumn("inside", F.lit(False)).select(*columns))
    if within is not None:
        past = F.coalesce(F.col("frag_ord") - F.col("parent_ord") > within, F.lit(False))
        out = out.withColumns({c: F.when(~past, F.col(c)) for c in ("parent", "parent_ord")} | {"inside": F.col("inside") & ~past})
    return out.unionByName(batch.filter("key is null").withColumns(none).select(*columns))


def followed(known: DataFrame, outer: DataFrame) -> DataFrame:
    """The spans of the clusters' table that ``outer`` asks for, where they are few; the whole table, where they are more than ``SPANS``."""
    spans = [r["span"] for r in outer.select("span").distinct().limit(SPANS + 1).collect()]
    return known.filter(F.col("span").isin(spans)) if len(spans) <= SPANS else known


def settle(batch: DataFrame, n: int, path: str, span: int = SPAN) -> None:
    """Writes the clusters of batch ``n`` (MET) to its own folder of the table at ``path``. A batch that runs again replaces its folder."""
    spark = batch.sparkSession
    tables = Tables(spark, "arrivals")
    try:
        rows = tables.table(batch, "met")
        first = F.min_by(F.struct("priority", "parent", "parent_ord", "inside"), F.when(F.col("parent").isNotNull(), F.col("key_ord")))
        one = tables.table(rows.groupBy("frag_id").agg(F.min("frag_ord").alias("frag_ord"), first.alias("m")).select("frag_id", "frag_ord", "m.*"), "first")
        above = roots(tables.table(one.filter("inside").select(F.col("frag_id").alias("node"), F.col("parent").alias("up")), "parents"), tables)
        top = one.join(above, F.col("frag_id") == F.col("node"), "left").select("frag_id", "frag_ord", "priority", F.coalesce("up", "frag_id").alias("top"))
        outer = one.filter("not inside and parent is not null").select(F.col("frag_id").alias("top"), F.col("parent").alias("_id"), F.floor(F.col("parent_ord") / span).alias("span"))
        outer = tables.table(outer, "outer")
        known = followed(table(spark, path).filter(F.col("batch") < n), outer) if n else spark.createDataFrame([], CLUSTERS)
        known = known.select(F.col("frag_id").alias("_id"), "span", "cluster")
        found = tables.table(known.join(F.broadcast(outer) if few(outer, PARENTS) else outer, ["_id", "span"]).select("top", "cluster").dropDuplicates(["top"]), "found")
        out = top.join(F.broadcast(found) if few(found, PARENTS) else found, "top", "left")
        out = out.select("frag_id", "frag_ord", F.coalesce("cluster", "top").alias("cluster"), "priority", F.floor(F.col("frag_ord") / span).alias("span"))
        per_span = out.groupBy("span").agg(F.least(F.lit(SHARES), F.ceil(F.count(F.lit(1)) / SHARE)).alias("_files"))
        out = out.join(per_span, "span").withColumn("_file", F.pmod(F.hash("frag_id"), F.col("_files")))
        out.repartition("span", "_file").drop("_file", "_files").write.mode("overwrite").partitionBy("span").parquet(f"{path}/batch={n}")
    finally:
        tables.close()


def start(keys: DataFrame, path: str, checkpoint: str, span: int = SPAN, within: int | None = None) -> StreamingQuery:
    """Clusters of all that has arrived, into the table at ``path``, then stops. ``checkpoint`` holds the stream's log and the state; a run begins where the last one
    ended. A batch that runs again replaces what it wrote."""

    def settled(batch: DataFrame, n: int) -> None:
        tables = Tables(batch.sparkSession, "met")
        try:
            settle(met(tables.table(batch, "batch"), n, f"{checkpoint}/latest", tables, within), n, path, span)
        finally:
            tables.close()

    return keys.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(settled).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """LATEST as written so far: for each key, and each batch that had it, the last fragment with it."""
    return spark.read.schema(LATEST).parquet(path)


def table(spark: SparkSession, path: str) -> DataFrame:
    """CLUSTERS as written so far: priority is that of the key by which the fragment joined, null where it joined none."""
    return spark.read.schema(CLUSTERS).parquet(path)


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """cluster, frag_id, frag_ord, key_used, confidence, reason, as ``identity.greedy_clusters`` tells them: by the best key of the cluster's matches."""
    rows = table(spark, path)
    best = rows.groupBy("cluster").agg(F.min("priority").alias("best"))
    return rows.join(best, "cluster").select("cluster", "frag_id", "frag_ord", *identity.match_by(F.col("best")))
