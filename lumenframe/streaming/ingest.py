"""Incremental ingest of late readings (an extension: the reference workload is batch only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, folder: str, like: str) -> DataFrame:
    """A stream over a folder of parquet files with the schema of the table at ``like``."""
    return spark.readStream.schema(spark.read.parquet(like).schema).option("maxFilesPerTrigger", 4).parquet(folder)


def first_arrivals(stream: DataFrame, keys: list[str], time: str, late: str = "30 days") -> DataFrame:
    """Each key once, by watermark: repeats within the lateness are dropped, and state older than it is freed."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def daily_counts(stream: DataFrame, time: str, late: str = "30 days") -> DataFrame:
    """(day, acq_id, points): arrivals by day, final once the watermark has passed the day."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), "acq_id").agg(F.count("*").alias("points")).select(F.col("w.start").alias("day"), "acq_id", "points")
