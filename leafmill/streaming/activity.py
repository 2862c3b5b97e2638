"""The activity log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_activity(spark: SparkSession, folder: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """JSON lines that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(folder)


def unseen(events: DataFrame, key: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Each event once; the state is bounded by the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def counts(events: DataFrame, time: str, by: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Events by window and kind; late ones count within the delay."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
