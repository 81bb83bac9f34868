"""Identity as fragments arrive, against one scan of all of them."""

import random

from pyspark.sql import functions as F
from test_engine import scan

from entityfusion.operators import identity
from entityfusion.plans.tables import Tables
from entityfusion.streaming import arrivals

NAMES = list(identity.CONFIDENCE)


def rows_of(keys, first=0):
    """Key rows of fragments ``first`` and on; those without keys get the row that says so."""
    return [
        (f"{i:06d}", i, j, *k) for i, ks in enumerate(keys, first) for j, k in enumerate(ks or [(None, None, str(i % 3))])
    ]


def arrive(spark, folder, batches, within=None, span=40):
    """Each batch is a file and a run of its own, which starts from the checkpoint of the one before."""
    at = 0
    for keys in batches:
        spark.createDataFrame(rows_of(keys, at), identity.KEYS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        at += len(keys)
        stream = spark.readStream.schema(identity.KEYS).parquet(f"{folder}/in")
        arrivals.start(stream, f"{folder}/out", f"{folder}/log", span, within).awaitTermination()
    return arrivals.clusters(spark, f"{folder}/out")


def test_arrivals_equal_one_scan(spark, tmp_path):
    """Hot keys, fragments without keys, keys that come twice in one fragment, chains inside a batch and over batches."""
    rng = random.Random(11)
    key = lambda: rng.choice([(1, "email", "hot"), *((p, NAMES[p], str(rng.randrange(60))) for p in (0, 1, 2, 4))])
    batches = [[sorted(key() for _ in range(rng.choice([0, 1, 1, 2, 3]))) for _ in range(n)] for n in (50, 1, 90)]
    keys = [ks for batch in batches for ks in batch]
    rows = arrive(spark, tmp_path, batches).collect()
    got = {int(r["frag_id"]): int(r["cluster"]) for r in rows}
    assert [got[i] for i in range(len(keys))] == scan(keys) and len(rows) == len(keys)
    frags = spark.createDataFrame([(f"{i:06d}", i) for i in range(len(keys))], "frag_id string, frag_ord bigint")
    whole = identity.greedy_clusters(frags, spark.createDataFrame([r for r in rows_of(keys) if r[4]], identity.KEYS), Tables(spark, "t"))
    told = lambda df: {(r["frag_id"], r["key_used"], r["confidence"], r["reason"]) for r in df.collect()}
    assert {(r["frag_id"], r["key_used"], r["confidence"], r["reason"]) for r in rows} == told(whole)
    spans = {r["span"] for r in arrivals.table(spark, f"{tmp_path}/out").select("span").distinct().collect()}
    assert spans == {0, 1, 2, 3}


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    e, p = (1, "email", "e"), (2, "phone", "p")
    before = sorted(map(tuple, arrive(spark, tmp_path, [[[e], [p]], [[e, p], [p]]]).collect()))
    again = [("000002", 2, 0, 1, "000000", 0, False), ("000002", 2, 1, 2, "000001", 1, False), ("000003", 3, 0, 2, "000002", 2, True)]
    arrivals.settle(spark.createDataFrame(again, arrivals.MET), 1, f"{tmp_path}/out", 40)
    assert sorted(map(tuple, arrivals.clusters(spark, f"{tmp_path}/out").collect())) == before
    assert [r[0] for r in before] == ["000000", "000000", "000000", "000001"]


def test_keys_lead_back_by_so_much(spark, tmp_path):
    """Inside a batch and over batches alike."""
    e = (1, "email", "e")
    got = {r["frag_id"]: r["cluster"] for r in arrive(spark, tmp_path, [[[e], [], [e], [], [], [e]], [[e], [], [], [e], []]], within=2).collect()}
    assert [int(got[f"{i:06d}"]) for i in range(11)] == [0, 1, 0, 3, 4, 5, 5, 7, 8, 9, 10]


def test_only_spans_that_are_followed_are_read(spark, tmp_path, monkeypatch):
    rows = [(str(i), i, str(i), None, 0, i // 10) for i in range(100)]
    spark.createDataFrame(rows, arrivals.CLUSTERS).write.partitionBy("batch", "span").parquet(f"{tmp_path}/out")
    sought = spark.createDataFrame([("15", 1), ("16", 1), ("71", 7)], "_id string, span bigint")
    got = arrivals.followed(arrivals.table(spark, f"{tmp_path}/out"), sought)
    assert {r["span"] for r in got.collect()} == {1, 7}
    assert "PartitionFilters: [span" in got._jdf.queryExecution().executedPlan().toString()
    assert arrivals.followed(arrivals.table(spark, f"{tmp_path}/out"), sought.limit(0)).count() == 0
    monkeypatch.setattr(arrivals, "SPANS", 1)
    assert arrivals.followed(arrivals.table(spark, f"{tmp_path}/out"), sought).count() == 100


def test_fragments_without_keys_are_rows(spark):
    empty = "cast(null as struct<linkedin: string, github: string>) as links, array() as emails, array() as phones"
    rows = spark.sql(f"select 'a' as frag_id, 0L as frag_ord, ' ' as full_name, {empty} union all select 'b', 1L, 'Ann', {empty}")
    item = lambda *names: f"array<struct<{','.join(f'{n}:string' for n in names)}>>"
    rows = rows.withColumns({"emails": F.col("emails").cast(item("normalized", "value")), "phones": F.col("phones").cast(item("e164", "raw")), "location": F.lit(None).cast("struct<city:string,country:string,country_code:string>")})
    got = [tuple(r)[2:5] for r in identity.identity_keys(rows, keyless=True).orderBy("frag_ord").collect()]
    assert got == [(0, None, None), (0, 4, "full_name")] and identity.identity_keys(rows).count() == 1


def test_a_batch_has_few_files_and_one_row_a_key(spark, tmp_path):
    """What a batch costs follows its rows: no files beyond what a span's rows need, a row of state a key, kept as a table."""
    keys = [[(1, "email", f"e{i % 150}")] for i in range(400)]
    rows = arrive(spark, tmp_path, [keys[:300], keys[300:]], span=100).collect()
    assert {int(r["cluster"]) for r in rows} == set(range(150)) and len(rows) == 400
    assert [len(list((tmp_path / "out").glob(f"batch={n}/span=*/*.parquet"))) for n in (0, 1)] == [3, 1]
    kept = {(r["batch"], r["value"]): r["frag_ord"] for r in arrivals.latest(spark, f"{tmp_path}/log/latest").collect()}
    assert kept == {(0, f"e{i}"): i + 150 for i in range(150)} | {(1, f"e{i % 150}"): i for i in range(300, 400)}
