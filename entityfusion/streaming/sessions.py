"""Sessions of evidence: pieces of one entity that arrive with gaps of less than a given time, in batch and stream by one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sessions(rows: DataFrame, by: str, time: str, gap: str, late: str = "0 seconds", **figures: Column) -> DataFrame:
    """by, begin, last, n, and ``figures`` (aggregates) of each session: a row belongs to the session before it if it comes less than ``gap`` after
    that session's last row. Rows without a time are in none; a null ``by`` is an entity like any other.

    In a stream a session is told once no row can join it any more: when the latest time seen, less ``late``, has passed its last row by the gap. Rows that come
    later than that are dropped, which is what ``late`` says; in a batch nothing is late."""
    given = rows.filter(F.col(time).isNotNull())
    if rows.isStreaming:
        given = given.withWatermark(time, late)
    made = given.groupBy(by, F.session_window(time, gap).alias("_session")).agg(F.max(time).alias("last"), F.count(F.lit(1)).alias("n"), *(c.alias(n) for n, c in figures.items()))
    return made.select(by, F.col("_session.start").alias("begin"), "last", "n", *figures)
