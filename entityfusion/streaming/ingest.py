"""Records that keep arriving: Structured Streaming from raw files to fragments. Fragments carry no order across batches: in the written table
``frag_ord`` is when a file was modified, which several may share, so the plan runs over ``written``, which numbers the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import ats_json, resume
from ..sources.base import fragments_of
from ..sources.ordered import numbered

#: df with ``raw`` -> df with ``parsed``, by source.
PARSERS = {
    "ats_json": ats_json.parsed, "resume_pdf": lambda df: resume.parsed(df, "resume_pdf"), "resume_docx": lambda df: resume.parsed(df, "resume_docx"),
}


def fragments(spark: SparkSession, folder: str, source: str = "ats_json", files_per_batch: int = 1000) -> DataFrame:
    """A stream of fragments of the text files that appear in ``folder``, one record each; files that hold equal records count once a day."""
    raw = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).text(folder)
    raw = raw.select(F.col("value").alias("raw"), F.col("_metadata.file_modification_time").alias("arrived"))
    # the state holds a record's hash, not the record
    fresh = raw.withColumn("_hash", F.sha2("raw", 256)).withWatermark("arrived", "1 day").dropDuplicatesWithinWatermark(["_hash"]).drop("_hash")
    return fragments_of(PARSERS[source](fresh.withColumn("frag_ord", F.unix_micros("arrived"))))


def write(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived to a Parquet table, exactly once, and stops."""
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written(spark: SparkSession, table: str, first_ord: int = 0) -> DataFrame:
    """The fragments of a written table, numbered by when they arrived."""
    arrived = spark.read.parquet(table).withColumnRenamed("frag_ord", "_arrived")
    rows = numbered(arrived, "_arrived", "frag_id", first=first_ord)
    return rows.select("frag_ord", *(c for c in arrived.columns if c != "_arrived"))
