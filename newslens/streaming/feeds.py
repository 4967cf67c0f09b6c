"""Incremental feed ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.operators.headlines import MAX_AGE_HOURS, MAX_PER_SOURCE, is_current
from newslens.sources.feeds import parse_feeds


def feed_stream(
    payloads: DataFrame, now: Column, max_items: int = MAX_PER_SOURCE, max_age_hours: int = MAX_AGE_HOURS
) -> DataFrame:
    """Headlines of landing payloads (source_id, fetched_at, body, rejected): parsed, capped per payload, current, and
    once per source and link (title where there is no link) within the age limit. Undated ones take their fetch time.
    """
    parsed = parse_feeds(payloads, max_items, ("source_id", "fetched_at")).where(is_current(now, max_age_hours))
    arrived = F.coalesce("published_at", "fetched_at").cast("timestamp")
    identity = F.when(F.col("link") == "", F.col("title")).otherwise(F.col("link"))
    timed = parsed.withColumns({"event_time": arrived, "identity": identity})
    return timed.withWatermark("event_time", f"{max_age_hours} hours").dropDuplicatesWithinWatermark(["source_id", "identity"])
