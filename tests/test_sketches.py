"""Sketches stored by part and merged later, against exact figures."""

import random

import pytest
from pyspark.sql import functions as F

from entityfusion.operators import sketches


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    # one hot group, a small one, one of nulls and NaN, a null group
    rows = [("hot", i % 30, f"s{rng.randrange(20_000)}", rng.gauss(0, 1)) for i in range(60_000)]
    rows += [("few", i % 3, f"s{i % 5}", float(i)) for i in range(40)] + [("none", 1, None, None), ("none", 2, None, float("nan"))] + [(None, i % 4, "x", 1.0) for i in range(8)]
    return spark.createDataFrame(rows, "who string, day int, source string, score double").repartition(9).cache()


def test_merged_is_within_its_error(spark, rows, tmp_path):
    sketches.sketched(rows, ["who", "day"], {"sources": "source"}, {"scores": "score"}).write.parquet(str(tmp_path / "days"))
    stored = spark.read.parquet(str(tmp_path / "days"))
    once = sketches.merged(stored, ["who"], ["sources"], ["scores"])
    # by way of halves of the days: the same within the error
    halves = sketches.merged(stored.withColumn("half", F.col("day") < 2), ["who", "half"], ["sources"], ["scores"])
    real = {w: (n, d, sorted(x for x in v if x == x)) for w, n, d, v in rows.groupBy("who").agg(F.count("*"), F.countDistinct("source"), F.collect_list("score")).collect()}
    for made in (once, sketches.merged(halves, ["who"], ["sources"], ["scores"])):
        ranks = (0.0, 0.1, 0.5, 0.9, 1.0)
        got = made.select("who", "n", sketches.distinct_count("sources"), *(sketches.quantile("scores", q) for q in ranks)).collect()
        assert {r[0] for r in got} == set(real)
        for who, n, distinct, *values in got:
            total, different, scores = real[who]
            assert n == total and abs(distinct - different) <= 4 * sketches.DISTINCT_ERROR * different
            for q, v in zip(ranks, values, strict=True):
                if not scores:
                    assert v is None
                    continue
                below, upto = (sum(f(x) for x in scores) / len(scores) for f in (lambda x: x < v, lambda x: x <= v))
                slack = 0 if len(scores) < 100 else 2 * sketches.RANK_ERROR
                assert below - slack <= q <= upto + slack + 1e-9


def test_sketches_of_nothing(rows):
    empty = sketches.sketched(rows.limit(0), ["who"], {"sources": "source"}, {"scores": "score"})
    assert empty.count() == 0 and sketches.merged(empty, ["who"], ["sources"], ["scores"]).count() == 0


def test_sketches_have_a_fixed_size(rows):
    size = sketches.sketched(rows, ["who"], {"sources": "source"}, {"scores": "score"}).agg(F.max(F.length("sources")), F.max(F.length("scores"))).first()
    assert size[0] < 5000 and size[1] < 20_000
