"""Outlet coverage and health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.functions.regions import REGION_ORDER, empty_region_text, is_low, region_label, region_rank
from newslens.functions.text import array_of

# Outlet states in a run, and the editorial stances.
OK, ERROR, NO_RECENT = "ok", "error", "sin_vigentes"
STANCES = ["oficialista", "oposicion"]


def region_coverage(outlets: DataFrame, current: DataFrame) -> DataFrame:
    """Per region: outlets with a feed, those with a current headline, and whether that is too few."""
    responders = current.select("source_id").distinct().withColumn("_answered", F.lit(True))
    return (
        outlets.where("has_feed").join(responders, "source_id", "left").groupBy("region")
        .agg(F.count("*").alias("configured"), F.count("_answered").alias("responded"))
        .withColumn("low", is_low(F.col("configured"), F.col("responded")))
    )


def edition_coverage(outlets: DataFrame, current: DataFrame) -> DataFrame:
    """`region_coverage` of every edition, all editorial regions included."""
    feeds = outlets.where("has_feed").select("source_id", "region")
    configured = feeds.groupBy("region").agg(F.count("*").alias("configured"))
    seen = current.select("edition_date", "source_id").distinct()
    responded = seen.join(feeds, "source_id").groupBy("edition_date", "region").agg(F.count("*").alias("responded"))
    grid = current.select("edition_date").distinct().select(
        "edition_date", F.explode(array_of(REGION_ORDER)).alias("region")
    )
    zero = F.lit(0).cast("bigint")
    return (
        grid.join(configured, "region", "left").join(responded, ["edition_date", "region"], "left")
        .select(
            "edition_date", "region",
            F.coalesce("configured", zero).alias("configured"), F.coalesce("responded", zero).alias("responded"),
        )
        .withColumn("low", is_low(F.col("configured"), F.col("responded")))
        .withColumn("empty_text", empty_region_text(F.col("configured"), F.col("responded")))
    )


def source_status(outlets: DataFrame, current: DataFrame, errors: DataFrame) -> DataFrame:
    """State of every outlet with a feed: a fetch error, nothing recent, or ok. `errors` has (source_id, detail)."""
    counts = current.groupBy("source_id").agg(F.count("*").alias("headlines"))
    status = (
        F.when(F.coalesce("detail", F.lit("")) != "", F.lit(ERROR))
        .when(F.col("headlines") == 0, F.lit(NO_RECENT))
        .otherwise(F.lit(OK))
    )
    return (
        outlets.where("has_feed").join(counts, "source_id", "left").join(errors, "source_id", "left")
        .withColumn("headlines", F.coalesce("headlines", F.lit(0).cast("bigint")))
        .withColumn("status", status)
        .select("source_id", "name", "country", "region", "status", F.coalesce("detail", F.lit("")).alias("detail"), "headlines")
    )


def source_problems(status: DataFrame) -> DataFrame:
    return status.where(F.col("status") != OK)


def public_outlets(outlets: DataFrame) -> DataFrame:
    """What is published of each outlet: everything but the feed address."""
    return outlets.select(
        "name", "country", "region", "stance", "ownership", "ownership_note", "homepage", "has_feed"
    )


def distinct_outlets(outlets: DataFrame, headlines: DataFrame) -> DataFrame:
    """Outlets that sent at least one headline, by country and name."""
    seen = headlines.select("source_id").distinct()
    return outlets.join(seen, "source_id", "left_semi").select("country", "name").orderBy("country", "name")


def outlets_by_country(outlets: DataFrame) -> DataFrame:
    """Country with its outlet names in order. Groups are bounded by the outlet list."""
    return outlets.groupBy("country").agg(F.array_sort(F.collect_list("name")).alias("names"))


def balance_matrix(outlets: DataFrame, stances: list[str] = STANCES) -> DataFrame:
    """Active outlets per region and stance with totals and countries, in editorial order."""
    inactive = outlets.agg(F.count_if(~F.col("has_feed"))).scalar()
    active = outlets.where("has_feed")
    return (
        active.groupBy("region").agg(
            *[F.count_if(F.col("stance") == s).alias(s) for s in stances],
            F.count("*").alias("total"),
            F.array_sort(F.collect_set("country")).alias("countries"),
        )
        .withColumns({
            "rank": region_rank(F.col("region")),
            "label": region_label(F.col("region")),
            "inactive": inactive,
        })
        .orderBy("rank", "region")
    )
