"""Interval joins: pairs of periods of a group that may overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import date_ranges_overlap


def overlapping(periods: DataFrame, by: str, key: str, start: str, end: str, days: int = 30) -> DataFrame:
    """by, left_key, right_key: the pairs of a group's periods that overlap, each once, the lesser key first. Keys are unique; starts are not null, an
    end that is null is open.

    Of two such periods the later one starts within the earlier. So each period is told to all bins of ``days`` days that it covers, and asked at
    the bin of its start only: a join on group and bin, which compares no periods that lie bins apart. Both sides are sorted and merged: a planner sees
    only the size of the periods' files and would send the told bins, many times as many rows, through the driver."""
    bin_of = lambda c: F.floor(F.unix_date(F.col(c).cast("date")) / days)
    last = periods.agg(F.max(bin_of(start)).alias("last")).first()["last"]
    held = periods.select(by, key, start, end)
    earlier = held.withColumn("bin", F.explode(F.sequence(bin_of(start), F.greatest(bin_of(start), F.least(F.coalesce(bin_of(end), F.lit(last)), F.lit(last))))))
    earlier = earlier.toDF(by, "key_1", "start_1", "end_1", "bin")
    later = held.withColumn("bin", bin_of(start)).toDF(by, "key_2", "start_2", "end_2", "bin")
    in_order = F.struct("start_1", "key_1") < F.struct("start_2", "key_2")
    met = earlier.hint("merge").join(later, [by, "bin"]).filter(in_order & date_ranges_overlap(*(F.col(c) for c in ("start_1", "end_1", "start_2", "end_2"))))
    return met.select(by, F.least("key_1", "key_2").alias("left_key"), F.greatest("key_1", "key_2").alias("right_key"))
