"""Windowed counts over event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.functions.text import epoch_us


def edition_window(events: DataFrame, stage: Column, delay: str = "72 hours") -> DataFrame:
    """Headlines per day and stage, updated as they arrive."""
    timed = events.withColumn("_at", F.timestamp_micros(epoch_us(F.col("ts")))).withWatermark("_at", delay)
    return timed.groupBy(F.window("_at", "1 day"), stage.alias("stage")).agg(F.count("*").alias("headlines")).select(
        F.col("window.start").alias("window_start"), "stage", "headlines"
    )


def signup_window(sends: DataFrame, cap: int, delay: str = "24 hours") -> DataFrame:
    """Confirmations in each 24-hour window, sliding by the hour, against the daily cap."""
    timed = sends.withColumn("_at", F.timestamp_micros(epoch_us(F.col("ts")))).withWatermark("_at", delay)
    counts = timed.groupBy(F.window("_at", "24 hours", "1 hour")).agg(F.count("*").alias("sent"))
    return counts.select(F.col("window.start").alias("window_start"), "sent", (F.col("sent") >= cap).alias("capped"))
