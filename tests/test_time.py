"""As-of joins, samples and sessions against their definitions."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from entityfusion import queries
from entityfusion.operators import asof, fusion, intervals, sampling
from entityfusion.plans import tables
from entityfusion.streaming import sessions


def test_as_of(spark):
    """A hot key over many ranges, ties, nulls, repeated rows, clashing names."""
    rng = random.Random(6)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None, "only rows"])
    rows = [(i, key(), rng.choice([None, *range(0, 60)])) for i in range(500)]
    rows.append(rows[0])
    versions = [(k, rng.choice([None, *range(5, 50)]), i, f"v{i}") for i, k in enumerate(key() for _ in range(400)) if k != "only rows"]
    left = spark.createDataFrame(rows, "id int, k string, at int").repartition(7)
    right = spark.createDataFrame(versions, "k string, at int, id int, value string").repartition(5)
    got = sorted(repr((r["id"], r["version"] and r["version"]["value"])) for r in asof.as_of(left, right, "k", "at", "at", "id").collect())

    def plain(k, at):
        known = [(a, i, v) for kk, a, i, v in versions if kk is not None and kk == k and a is not None and at is not None and a <= at]
        return max(known)[2] if known else None

    assert got == sorted(repr((i, plain(k, at))) for i, k, at in rows)
    assert asof.as_of(left.limit(0), right, "k", "at", "at", "id").count() == 0
    assert asof.as_of(left, right.limit(0), "k", "at", "at", "id").filter("version is null").count() == len(rows)


def test_samples(spark):
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 50 == 0, "rare").when(F.col("id") % 7 == 0, F.lit(None)).otherwise("hot").alias("s"))
    one = {tuple(r) for r in sampling.stratified(rows, "s", "id", 150).collect()}
    assert {tuple(r) for r in sampling.stratified(rows.repartition(13, "id"), "s", "id", 150).collect()} == one
    sizes = {}
    for _, s in one:
        sizes[s] = sizes.get(s, 0) + 1
    assert sizes == {"rare": 100, None: 150, "hot": 150}
    parts = sampling.stratified(rows.filter("id < 2000"), "s", "id", 150).unionByName(sampling.stratified(rows.filter("id >= 2000"), "s", "id", 150))
    assert {tuple(r) for r in sampling.stratified(parts, "s", "id", 150).collect()} == one
    assert {tuple(r) for r in sampling.stratified(rows, "s", "id", 150, "other").collect()} != one and sampling.stratified(rows, "s", "id", 0).count() == 0
    plan = sampling.stratified(rows, "s", "id", 150)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_sessions_in_batch_and_stream(spark, tmp_path):
    """A stream tells the sessions that are over, as the batch has them; what comes too late is dropped."""
    t0 = datetime(2024, 1, 1)
    minutes = lambda m: t0 + timedelta(minutes=m)
    first = [("a", minutes(0)), ("a", minutes(9)), ("a", minutes(30)), (None, minutes(1)), ("b", minutes(3)), ("a", None)]
    second = [("a", minutes(35)), ("b", minutes(300))]
    third = [("a", minutes(12)), ("b", minutes(301))]  # the first of them is late by hours
    schema = "who string, at timestamp"
    folder = tmp_path / "in"
    for i, part in enumerate((first, second, third)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = sessions.sessions(spark.readStream.schema(schema).parquet(str(folder)), "who", "at", "10 minutes", "20 minutes")
        run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    told = {(r["who"], r["begin"], r["last"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r["who"], r["begin"], r["last"], r["n"]) for r in sessions.sessions(spark.createDataFrame(first + second, schema), "who", "at", "10 minutes").collect()}
    assert batch == {("a", minutes(0), minutes(9), 2), ("a", minutes(30), minutes(35), 2), (None, minutes(1), minutes(1), 1), ("b", minutes(3), minutes(3), 1), ("b", minutes(300), minutes(300), 1)}
    assert told == {s for s in batch if s[1] < minutes(300)}


def test_told_bins_do_not_go_through_the_driver(spark, tmp_path):
    """Few periods in a small file, told to many bins each: the planner knows only the file."""
    rows = [(i % 5, i, datetime(1995, 1, 1) + timedelta(days=i), None) for i in range(300)]
    spark.createDataFrame(rows, "g int, k int, s timestamp, e timestamp").write.parquet(f"{tmp_path}/periods")
    made = intervals.overlapping(spark.read.parquet(f"{tmp_path}/periods"), "g", "k", "s", "e", days=1)
    assert made.count() == 5 * 60 * 59 // 2
    made.collect()
    assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()


def test_ranges_grow_with_rows(spark, monkeypatch):
    """However small the rows are in bytes: what one task sorts is bounded by their number."""
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    rows = spark.range(1500).selectExpr("id % 7 as k", "id as t")
    made = asof.as_of(rows, rows.filter("t % 3 = 0"), "k", "t", "t", "t")
    assert made.rdd.getNumPartitions() == 20
    assert all(r["version"] is None or r["version"]["t"] <= r["t"] for r in made.collect()) and made.count() == 1500


def test_decisions_are_dealt_by_rows(spark):
    items = spark.range(900).selectExpr("id % 90 as cluster", "id as ord", "cast(id % 2 as string) as value")
    made = fusion.merge_decisions(items, items.groupBy("cluster").agg(F.max("value").alias("value")), "headline", parts=9)
    assert made.rdd.getNumPartitions() == 9 and {len(r["competing"]) for r in made.collect()} == {10}


def test_small_files_of_costly_rows_are_many_tasks(spark, tmp_path):
    spark.range(40).selectExpr("id as c_custkey", "cast(id % 5 as int) as c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    made = queries.json_links(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and made.count() == 40
