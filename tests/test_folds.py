"""Folds of large clusters, parted by components, against one scan."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from entityfusion.operators import fusion
from entityfusion.schemas import EDUCATION, EXPERIENCE

JOB = EXPERIENCE[:-1] + ",company_key:string,company_canonical_key:string>"


def jobs(rng, n, employers, titles):
    out = []
    for i in range(n):
        raw, canonical = rng.choice(employers), rng.choice([None, None, *employers])
        title, named = rng.choice([*titles, "", None]), rng.choice([None, None, *titles])
        start = rng.choice([None, date(rng.randint(1990, 2020), rng.randint(1, 12), 1)])
        end = rng.choice([None, date(rng.randint(1990, 2020), 1, 1)])
        place = rng.choice([None, {"raw": None, "city": rng.choice(["Ulm", "Bonn"]), "region": None, "country": rng.choice(["de", None]), "country_code": None}])
        out.append(
            {
                "company": raw, "company_canonical": canonical, "title": title, "title_canonical": named, "start": start, "end": end, "summary": rng.choice([None, "built tools", "built more tools"]), "location": place, "confidence": 1.0, "evidence_ids": [str(i)],
                "company_key": raw and raw.lower(), "company_canonical_key": canonical and canonical.lower(),
            }
        )
    return out


def schools(rng, n, names):
    year = lambda: rng.choice([None, rng.randint(1990, 1995)])
    return [
        {"institution": rng.choice([*names, ""]), "degree": rng.choice(["BA", "MA", ""]), "degree_canonical": rng.choice([None, "Bachelor"]), "field": rng.choice([None, "Law", "law ", "Art"]), "start_year": year(), "end_year": year(), "confidence": 0.5, "evidence_ids": [str(i)]}
        for i in range(n)
    ]


def names(n, word):
    return [f"{word} {i}" for i in range(n)]


@pytest.mark.parametrize("kind", ["experience", "education"])
def test_large_clusters_are_one_scan(spark, monkeypatch, kind):
    rng = random.Random(11)
    fold, shape, make = (fusion.EXPERIENCE, JOB, lambda n: jobs(rng, n, [*names(n // 3, "Firm"), "ACME", "Acme", None], names(n // 3, "Job"))) if kind == "experience" else (fusion.EDUCATION, EDUCATION, lambda n: schools(rng, n, ["Uni  1", "uni 1", *names(n // 4, "School")]))
    held = {c: make(n) for c, n in ((1, 60), (2, 3), (3, 150), (4, 40), (None, 5))}
    rows = [(c, i, x) for c, items in held.items() for i, x in enumerate(items)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"cluster bigint, ord bigint, item {shape}").repartition(3)
    want = {c: fusion.fold_items(items, fold) for c, items in held.items()}
    for large in (40, 10_000, 1):
        monkeypatch.setattr(fusion, "LARGE", large)
        got = {r["cluster"]: [x.asDict(True) for x in r[kind]] for r in getattr(fusion, f"fold_{kind}")(df).collect()}
        assert got == want, large


def test_a_giant_cluster_over_many_tasks(spark):
    """60,000 items of one cluster: no task folds more than a component, and nothing is lost."""
    n = 60_000
    null = F.lit(None).cast("string")
    k = (F.col("id") / 3).cast("bigint")
    item = F.struct(
        F.concat(F.lit("Firm "), k).alias("company"), null.alias("company_canonical"), F.concat(F.lit("Job "), F.col("id") % 2, F.lit(" at "), k).alias("title"), null.alias("title_canonical"), F.lit(date(2000, 1, 1)).alias("start"), F.lit(None).cast("date").alias("end"), null.alias("summary"),
        F.lit(None).cast("struct<raw:string,city:string,region:string,country:string,country_code:string>").alias("location"), F.lit(1.0).alias("confidence"), F.array(F.col("id").cast("string")).alias("evidence_ids"), F.concat(F.lit("firm "), k).alias("company_key"), null.alias("company_canonical_key"),
    )
    made = fusion.fold_experience(spark.range(n).select(F.lit(7).alias("cluster"), F.col("id").alias("ord"), item.alias("item"))).select(F.explode("experience").alias("x"))
    assert made.agg(F.count(F.lit(1)), F.sum(F.size("x.evidence_ids"))).first() == (n // 3, n)


def test_no_items(spark):
    assert fusion.fold_education(spark.createDataFrame([], f"cluster bigint, ord bigint, item {EDUCATION}")).count() == 0
