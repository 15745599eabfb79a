"""Reading the stored tables, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywarden.schemas import TABLES


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One stored table with its fixed schema."""
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def stream_events(
    spark: SparkSession,
    sf_dir: str,
    delay: str = "10 minutes",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """The events table as a stream with event time and a watermark.

    The path ends in a character class so that it is a glob: that way a single
    file and a folder of part files are both accepted as a streaming source.
    """
    reader = spark.readStream.schema(TABLES["events"])
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    events = reader.parquet(f"{sf_dir}/events.parque[t]")
    # A watermark needs a zoned timestamp.
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
