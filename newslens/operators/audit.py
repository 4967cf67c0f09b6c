"""Fate of every headline, funnel counts, models, cost, budget and edition versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from newslens.operators.numbering import sliced_row_number, sliced_running_sum
from newslens.session import staged

# Stages of a headline, reasons and default labels.
PREFILTER_REJECTED = "prefilter_rejected"
CLASSIFIER_REJECTED = "classifier_rejected"
CLASSIFIER_ERROR = "classifier_error"
ACCEPTED = "accepted"
PREFILTER_REASON = (
    "no menciona dos o más países, una empresa multinacional de la lista ni una palabra clave de comercio/tratados"
)
ORIGINAL_REASON = "edición original"
UNSTATED_REASON = "regenerada sin motivo declarado"
OTHER_STAGE = "otros"


def audit_entries(scored: DataFrame, use_prefilter: bool) -> DataFrame:
    """One row per headline with its stage and reason, in a single pass over the scored headlines.

    Expects passed, error (NULL when the scorer answered), is_international, model, reason, relation_type, confidence.
    """
    blocked = ~F.col("passed") if use_prefilter else F.lit(False)
    failed = F.col("error").isNotNull()
    stage = (
        F.when(blocked, PREFILTER_REJECTED).when(failed, CLASSIFIER_ERROR)
        .when(F.col("is_international"), ACCEPTED).otherwise(CLASSIFIER_REJECTED)
    )
    reason = F.when(blocked, PREFILTER_REASON).when(failed, F.col("error")).otherwise(F.col("reason"))
    answered = ~blocked & ~failed
    return scored.select(
        "seq", "edition_date", F.col("name").alias("source"), "country", "title", "link",
        stage.alias("stage"), reason.alias("reason"),
        F.when(answered, F.col("relation_type")).alias("relation_type"),
        F.when(answered, F.col("model")).alias("model"),
        F.when(answered, F.col("confidence")).alias("confidence"),
    )


def audit_sorted(audit: DataFrame) -> DataFrame:
    """Published order: source, then title."""
    return audit.orderBy("edition_date", "source", "title", "seq")


def audit_counts(audit: DataFrame) -> DataFrame:
    """Funnel per edition: headlines and how many ended at each stage."""
    return audit.groupBy("edition_date").agg(
        *[(F.count("*") if s is None else F.count_if(F.col("stage") == s)).alias(n) for n, s in STAGE_COUNTS.items()]
    )


STAGE_COUNTS = {
    "fetched": None, "prefilter_rejected": PREFILTER_REJECTED, "classifier_rejected": CLASSIFIER_REJECTED, "classifier_errors": CLASSIFIER_ERROR,
    "accepted": ACCEPTED,
}


def observed(audit: DataFrame, name: str = "funnel") -> tuple[DataFrame, Observation]:
    """The same rows, with the funnel of all of them counted as they are written: no second scan.

    `Observation.get` has the counts once the rows have been written; `audit_counts` gives the same by edition from the written table.
    """
    funnel = Observation(name)
    counts = [(F.count(F.lit(1)) if s is None else F.count_if(F.col("stage") == s)).alias(n) for n, s in STAGE_COUNTS.items()]
    return audit.observe(funnel, *counts), funnel


def with_source_counts(counts: DataFrame, headlines: DataFrame, outlets: DataFrame) -> DataFrame:
    """Adds configured and responding outlets to the funnel of each edition."""
    feeds = outlets.where("has_feed").select("source_id")
    responded = (
        headlines.select("edition_date", "source_id").distinct().join(feeds, "source_id", "left_semi")
        .groupBy("edition_date").agg(F.count("*").alias("sources_responded"))
    )
    return counts.join(responded, "edition_date", "left").withColumns({
        "sources_configured": outlets.where("has_feed").agg(F.count("*")).scalar(),
        "sources_responded": F.coalesce("sources_responded", F.lit(0).cast("bigint")),
    })


def models_used(audit: DataFrame) -> DataFrame:
    """Headlines each model decided, most used first within the edition."""
    used = audit.where(F.col("model").isNotNull()).groupBy("edition_date", "model").agg(F.count("*").alias("notes"))
    return used.orderBy("edition_date", F.desc("notes"), "model")


def fallback_used(audit: DataFrame, primary: str) -> DataFrame:
    """Whether a model other than the primary one decided anything."""
    return audit.groupBy("edition_date").agg(
        F.coalesce(F.bool_or(F.col("model") != primary), F.lit(False)).alias("fallback_used")
    )


def cost_by_stage(usage: DataFrame) -> DataFrame:
    """Requests, tokens and cost per run and stage, with a total row (stage NULL) per run."""
    told = usage.withColumn("stage", F.coalesce("stage", F.lit(OTHER_STAGE)))
    return told.groupingSets([["run", "stage"], ["run"]], "run", "stage").agg(
        F.sum("cost").alias("cost"), F.count("*").alias("requests"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
    )


def budget_gate(usage: DataFrame, budget: Column, optional: list[str], order: str = "event_id") -> DataFrame:
    """Spend of the run before each request, and whether an optional stage is skipped for it."""
    running = sliced_running_sum(
        usage, ["run"], [(order, True)], F.col("cost"), "spent_before", inclusive=False
    )
    skip = F.col("stage").isin(optional) & (F.col("spent_before") >= budget)
    return running.withColumn("skipped", F.coalesce(skip, F.lit(False)))


def edition_versions(generations: DataFrame, order: str = "event_id") -> DataFrame:
    """Version number of every generation of an edition, with the default reasons filled in."""
    numbered = sliced_row_number(generations, ["edition_date"], [(order, True)], "version")
    reason = (
        F.when(F.col("version") == 1, ORIGINAL_REASON)
        .when(F.coalesce("reason", F.lit("")) == "", UNSTATED_REASON)
        .otherwise(F.col("reason"))
    )
    return numbered.withColumn("reason", reason)


def latest_version(versions: DataFrame) -> DataFrame:
    """Current version of each edition with its reason; nothing is shown for editions never regenerated."""
    last = versions.groupBy("edition_date").agg(F.max("version").alias("version")).where(F.col("version") >= 2)
    return versions.join(last, ["edition_date", "version"], "left_semi")


def version_intervals(generations: DataFrame, at: str = "generated_at", order: str = "event_id") -> DataFrame:
    """Versions of each edition with the time in which each was public: from `valid_from` on, up to `valid_to` (null: still) without it.

    Versions are numbered by the time of their generation, then `order`; of several of one moment only the last was ever public, and the others
    have an empty interval. Each version meets its successor on its number, so an edition of any number of versions is not sorted in one task.
    """
    numbered = staged(sliced_row_number(generations, ["edition_date"], [(at, True), (order, True)], "version"))
    after = numbered.select(F.col("edition_date").alias("_edition"), (F.col("version") - 1).alias("_version"), F.col(at).alias("valid_to"))
    same = F.col("edition_date").eqNullSafe(F.col("_edition")) & (F.col("version") == F.col("_version"))
    return numbered.join(after, same, "left").drop("_edition", "_version").withColumnRenamed(at, "valid_from")


def edition_as_of(intervals: DataFrame, moments: DataFrame) -> DataFrame:
    """For each of `moments` (edition_date, moment, and any other columns) the version that was public then; null before the first.

    The number of versions that an edition had had by a moment is the number of the version then public, so this is a running count over versions
    and moments together, in slices of time, and no join by ranges.
    """
    rest = [c for c in moments.columns if c not in ("edition_date", "moment")]
    versions = intervals.select("edition_date", F.col("valid_from").alias("moment"), F.lit(0).alias("_kind"), F.lit(1).alias("_one"))
    asked = moments.select("edition_date", "moment", F.lit(1).alias("_kind"), F.lit(0).alias("_one"), *rest)
    both = versions.unionByName(asked, allowMissingColumns=True)
    counted = sliced_running_sum(both, ["edition_date"], [("moment", True), ("_kind", True)], F.col("_one"), "version")
    found = counted.where(F.col("_kind") == 1).select("edition_date", "moment", *rest, F.nullif("version", F.lit(0)).alias("version"))
    known = intervals.select(F.col("edition_date").alias("_edition"), F.col("version").alias("_version"), *[c for c in intervals.columns if c not in ("edition_date", "version", *rest)])
    same = F.col("edition_date").eqNullSafe(F.col("_edition")) & (F.col("version") == F.col("_version"))
    return found.join(known, same, "left").drop("_edition", "_version")


def corrections(versions: DataFrame) -> DataFrame:
    """All generations of editions that were generated more than once, newest edition first.

    The history stays one row per version: an edition may have any number of them.
    """
    regenerated = versions.groupBy("edition_date").agg(F.max("version").alias("versions")).where(F.col("versions") >= 2)
    return versions.join(regenerated, "edition_date").orderBy(F.desc("edition_date"), "version")


def month_archive(editions: DataFrame) -> DataFrame:
    """Edition dates of each month, newest first; a month has at most 31."""
    days = editions.select("edition_date").distinct()
    return (
        days.groupBy(F.date_format("edition_date", "yyyy-MM").alias("month"))
        .agg(F.reverse(F.array_sort(F.collect_list(F.col("edition_date").cast("string")))).alias("dates"))
        .orderBy(F.desc("month"))
    )


def feed_window(editions: DataFrame, days: int = 7) -> DataFrame:
    """Editions of the last `days` days, counted back from the newest edition."""
    newest = editions.agg(F.max("edition_date")).scalar()
    return editions.where(F.col("edition_date") >= F.date_sub(newest, days - 1))
