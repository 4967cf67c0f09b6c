"""The daily edition from feed payloads to what a report is written from, as one plan of the operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.functions.wires import WIRE_AGENCIES
from newslens.operators import audit, coverage, headlines, reports, stories, tagging
from newslens.session import staged
from newslens.sources import feeds


@dataclass
class Edition:
    """Tables of one run. Parsed and scored headlines, the audit and accepted notes are written; the rest is computed when it is read."""

    current: DataFrame
    coverage: DataFrame
    status: DataFrame
    audit: DataFrame
    counts: DataFrame
    notes: DataFrame
    outlets: DataFrame
    #: Counts of all headlines by stage, gathered while the audit was written.
    funnel: dict[str, int]

    def digest(self) -> DataFrame:
        """Lines a report is written from; computed only when asked for."""
        return reports.digest_input(self.notes, self.outlets, self.current)


def by_rules(relations: list[tuple[str, str]]) -> Callable[[DataFrame], DataFrame]:
    """The deterministic classifier of a run."""

    def classify(tagged: DataFrame) -> DataFrame:
        return tagging.rule_classify(tagged, relations).withColumns(
            {"error": F.lit(None).cast("string"), "model": F.lit("rules"), "reason": F.concat(F.lit("regla "), F.col("relation_type"))}
        )

    return classify


def run_edition(
    payloads: DataFrame,
    outlets: DataFrame,
    gazetteer: tagging.Gazetteer,
    relations: list[tuple[str, str]],
    now: Column,
    keys: tuple[str, ...],
    max_items: int = headlines.MAX_PER_SOURCE,
    max_age_hours: int = headlines.MAX_AGE_HOURS,
    use_prefilter: bool = True,
    wires: list[tuple[str, str]] = WIRE_AGENCIES,
    classify: Callable[[DataFrame], DataFrame] | None = None,
    groups: Callable[[DataFrame], DataFrame] | None = None,
) -> Edition:
    """Parse, cap, drop stale, attach outlets, tag and classify by rule, then audit, group and lay out.

    `payloads` has `keys` (source_id and edition_date among them), `body` and `rejected`. Feeds are read once: parsed
    headlines are written out and everything else starts from them. `classify` adds relation_type, is_international,
    error, model and reason to tagged headlines, as a batch scorer does (None: by rules); `groups` gives groups of the
    same event (edition_date, group_no, event, seq) for the accepted notes (None: by signature).
    """
    ordered = feeds.parse_feeds(payloads, max_items, keys).orderBy(*keys, "feed_pos")
    # Range partitions in order, so the id follows the keys and is dense within each partition.
    parsed = staged(ordered.withColumn("seq", F.monotonically_increasing_id()))
    errors = feeds.feed_failures(payloads, parsed, keys).groupBy("source_id").agg(F.max("detail").alias("detail"))
    current = headlines.drop_stale(parsed, now, max_age_hours)
    scored = staged((classify or by_rules(relations))(tagging.prefilter(headlines.headline_outlet(current, outlets), gazetteer)))
    watched, funnel = audit.observed(audit.audit_entries(scored, use_prefilter))
    entries = staged(watched)
    kept = scored.where(F.col("is_international") if use_prefilter else F.col("relation_type") != "none")
    notes = stories.with_voices(
        kept.withColumnsRenamed({"matched_countries": "countries", "matched_companies": "companies"}),
        F.concat_ws(" ", "title", "snippet"), wires,
    )
    counts = audit.with_source_counts(audit.audit_counts(entries), current, outlets)
    notes = staged(stories.group_assign(notes, groups(notes)) if groups else notes)
    return Edition(
        current, coverage.region_coverage(outlets, current), coverage.source_status(outlets, current, errors), entries, counts,
        notes, outlets, funnel.get,
    )
