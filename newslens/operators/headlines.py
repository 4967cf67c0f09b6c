"""Headline hygiene: cap per feed, age filter, outlet join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headlines taken per feed, and the age limit of a headline.
MAX_PER_SOURCE = 6
MAX_AGE_HOURS = 72


def cap_per_source(h: DataFrame, n: int = MAX_PER_SOURCE, feed: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """First `n` headlines of each feed. The rank limit runs before the shuffle, so a hot feed sends n rows per task."""
    w = Window.partitionBy(*feed).orderBy("feed_pos")
    return h.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def is_current(now: Column, max_age_hours: int = MAX_AGE_HOURS) -> Column:
    """Undated and future headlines count as current."""
    oldest = now - F.expr(f"INTERVAL {int(max_age_hours)} HOURS")
    return F.col("published_at").isNull() | (F.col("published_at") >= oldest)


def drop_stale(h: DataFrame, now: Column, max_age_hours: int = MAX_AGE_HOURS) -> DataFrame:
    return h.where(is_current(now, max_age_hours))


def stale_by_source(h: DataFrame, outlets: DataFrame, now: Column, max_age_hours: int = MAX_AGE_HOURS) -> DataFrame:
    """Headlines dropped for their age, per outlet name; counted before the outlet join."""
    dropped = h.where(~is_current(now, max_age_hours)).groupBy("source_id").agg(F.count("*").alias("dropped"))
    return dropped.join(outlets, "source_id").groupBy("name").agg(F.sum("dropped").alias("dropped"))


def headline_outlet(h: DataFrame, outlets: DataFrame) -> DataFrame:
    """Headline with its outlet. The optimizer broadcasts the outlets when their measured size allows it."""
    return h.join(outlets, "source_id")
