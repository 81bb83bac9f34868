"""Samples of exact size that don't depend on how rows are dealt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def draw(key: Column, seed: str) -> Column:
    """A row's place in the lottery: the hash of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")))


def stratified(rows: DataFrame, stratum: str, key: str, k: int, seed: str = "0") -> DataFrame:
    """k rows of each stratum (all if it has fewer): those whose draws come first. ``key`` tells rows of a stratum apart; of rows with equal keys
    any may be taken. A null stratum is one like any other.

    Each task keeps its first k of a stratum before anything is shuffled, and a stratum's rows meet in SALTS groups before they meet at all, so a hot stratum sends
    k rows a task and joins SALTS * k in the end. Samples merge: the sample of two samples of the same k and seed is that of all their rows."""
    if k < 1:
        return rows.limit(0)
    drawn = rows.withColumn("_draw", draw(F.col(key), seed)).withColumn("_salt", F.pmod(F.xxhash64("_draw"), F.lit(SALTS)))
    for by in ((stratum, "_salt"), (stratum,)):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("_draw", key))
        drawn = drawn.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")
    return drawn.drop("_draw", "_salt")
