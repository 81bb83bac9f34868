"""As-of joins: the version of a key that was valid at a row's time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import Tables, shares


def as_of(rows: DataFrame, versions: DataFrame, by: str, time: str, valid_from: str, tie: str, found: str = "version", tables: Tables | None = None) -> DataFrame:
    """rows with ``found``: of the versions of the same ``by`` the latest with ``valid_from`` <= ``time``, as a struct of its columns; null where there is
    none. Of versions with equal times that with the greatest ``tie`` counts. Rows without key or time have no version; versions without either
    are none. All rows are kept.

    Both sides are sorted once, together, by ranges of key and time. Within a range the last version seen is carried along; the last one of each range
    (one small row each) is told to the ranges after it. So a key of any number of rows or versions lies over many tasks, and there are as many ranges as
    the rows need."""
    tables = tables or Tables(rows.sparkSession, "asof")
    # a version is a struct, so that columns of either side may have any name
    told = versions.filter(F.col(by).isNotNull() & F.col(valid_from).isNotNull()).select(F.col(by).alias("_by"), F.col(valid_from).alias("_at"), F.lit(0).alias("_kind"), F.col(tie).alias("_tie"), F.struct(*versions.columns).alias("_v"))
    none = lambda c, of: F.lit(None).cast(of.schema[c].dataType).alias(c)
    asked = rows.select(F.col(by).alias("_by"), F.col(time).alias("_at"), F.lit(1).alias("_kind"), F.struct(*rows.columns).alias("_r"))
    both = told.withColumn("_r", F.lit(None).cast(asked.schema["_r"].dataType)).unionByName(asked.withColumn("_tie", none("_tie", told)).withColumn("_v", none("_v", told)))
    order = ("_by", "_at", "_kind", "_tie")
    n = shares(rows.sparkSession, rows.count() + versions.count())
    dealt = tables.table(both.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "sorted")
    carried = F.when(F.col("_kind") == 0, F.struct("_by", "_v"))
    last = dealt.filter("_kind = 0").groupBy("_part").agg(F.max_by(F.struct("_by", "_v"), F.struct("_by", "_at", "_tie")).alias("_last"))
    parts = dealt.select("_part").distinct().join(last, "_part", "left")  # a row a range
    before = parts.select("_part", F.last("_last", True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    here = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.join(F.broadcast(before), "_part").repartition(n, "_part").withColumn("_seen", F.coalesce(F.last(carried, True).over(here), "_before")).filter("_kind = 1")
    return met.select("_r.*", F.when((F.col("_seen._by") == F.col("_by")) & F.col("_at").isNotNull(), F.col("_seen._v")).alias(found))
