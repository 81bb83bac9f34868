"""Numbering rows by sort keys without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import Tables


def numbered(df: DataFrame, *order: str, first: int = 0) -> DataFrame:
    """df with ``frag_ord`` (bigint): its place by ``order``, from ``first`` on.

    Rows are sorted by ranges and written once with their range and place in it; ranges are then counted (one small row each), so
    numbers and counts are of the same rows however often either is computed."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    rows = Tables(df.sparkSession, "numbered").table(rows)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_begin"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before).select("_part", "_before", "_begin")
    return rows.join(sizes, "_part").withColumn("frag_ord", F.col("_before") + F.col("_at") - F.col("_begin") + first).drop("_part", "_at", "_before", "_begin")
