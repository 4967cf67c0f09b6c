"""Stories: notes grouped by event, independent voices, wire copies and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.functions.binding import let
from newslens.functions.text import normalize_set
from newslens.functions.wires import WIRE_AGENCIES, detect_wire, voice_key
from newslens.operators.numbering import sliced_row_number
from newslens.session import staged

EDITION = "edition_date"


def story_signature(companies: Column, countries: Column, relation_type: Column) -> Column:
    """Likely-same-story key from extracted entities; NULL when there is nothing to go by."""
    firms, places = normalize_set(companies), normalize_set(countries)
    return (
        F.when(F.size(firms) > 0, F.concat(F.lit("company:"), F.array_join(firms, "+"), F.lit("|"), relation_type))
        .when(F.size(places) > 0, F.concat(F.lit("countries:"), F.array_join(places, "+"), F.lit("|"), relation_type))
    )


def singleton(key: str = "seq") -> Column:
    return F.concat(F.lit("singleton:"), F.col(key).cast("string"))


def with_voices(notes: DataFrame, text: Column, wires: list[tuple[str, str]] = WIRE_AGENCIES) -> DataFrame:
    """Adds wire, voice and cluster_key (by signature) to classified notes."""
    signature = story_signature(F.col("companies"), F.col("countries"), F.col("relation_type"))
    return (
        notes.withColumn("wire", detect_wire(text, F.col("name"), wires))
        .withColumn("voice", voice_key(F.col("wire"), F.col("ownership"), F.col("country"), F.col("source_id")))
        .withColumn("signature", signature)
        .withColumn("cluster_key", F.coalesce("signature", singleton()))
    )


def group_assign(notes: DataFrame, groups: DataFrame) -> DataFrame:
    """Cluster keys from groups (edition_date, group_no, event, seq); notes outside any group stay alone."""
    key = F.when(F.col("group_no").isNotNull(), F.concat(F.lit("group:"), F.col("group_no").cast("string")))
    return (
        notes.join(groups, [EDITION, "seq"], "left")
        .withColumn("cluster_key", F.coalesce(key, singleton()))
        .drop("group_no")
    )


def _member_counts(notes: DataFrame) -> DataFrame:
    """Notes per (cluster, outlet, voice, wire): few rows per cluster however many notes it has."""
    return notes.groupBy(EDITION, "cluster_key", "source_id", "country", "voice", "wire").agg(
        F.count("*").alias("notes"), F.min("seq").alias("first_seq")
    )


def story_clusters(notes: DataFrame) -> DataFrame:
    """Size of each story in notes, outlets, countries and independent voices, with its weight.

    Notes are reduced to their distinct (outlet, voice, wire) per story first, so the sets below hold outlets, which
    the outlet list bounds, and never notes.
    """
    size = lambda c: F.size(F.collect_set(c)).cast("bigint")
    own_country = F.when(F.col("wire").isNull(), F.col("country"))
    clusters = _member_counts(notes).groupBy(EDITION, "cluster_key").agg(
        F.sum("notes").alias("notes"), F.min("first_seq").alias("first_seq"),
        size(F.col("source_id")).alias("sources"), size(F.col("country")).alias("countries"),
        size(F.col("voice")).alias("voices"), size(own_country).alias("voice_countries"),
    )
    return clusters.withColumn("weight", F.col("voices") + F.col("voice_countries") * 2)


def wire_summary(notes: DataFrame) -> DataFrame:
    """Per story the agencies it was taken from: as text, in notes and in outlets."""
    copies = notes.where(F.col("wire").isNotNull()).groupBy(EDITION, "cluster_key", "wire", "source_id").agg(
        F.count("*").alias("notes")
    )
    per_wire = copies.groupBy(EDITION, "cluster_key", "wire").agg(
        F.sum("notes").alias("notes"), F.count("*").alias("outlets")
    )
    ordered = F.array_sort(F.collect_list(F.struct("wire", "notes")))
    text = F.transform(ordered, lambda w: F.concat(w["wire"], F.lit(" en "), w["notes"].cast("string"), F.lit(" medios")))
    return per_wire.groupBy(EDITION, "cluster_key").agg(
        F.array_join(text, ", ").alias("wires"),
        F.sum("notes").alias("wire_notes"), F.sum("outlets").alias("wire_outlets"),
    )


def cluster_rank(clusters: DataFrame) -> DataFrame:
    """Rank of each story in its edition by weight, ties by first appearance."""
    return sliced_row_number(clusters, [EDITION], [("weight", False), ("first_seq", True)], "rank")


def cross_coverage(notes: DataFrame) -> DataFrame:
    """Stories more than one outlet carries: title, media countries in order of appearance, voices and rank."""
    clusters = cluster_rank(story_clusters(notes)).where(F.col("sources") > 1)
    seen = notes.groupBy(EDITION, "cluster_key", "country").agg(F.min("seq").alias("at"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "country"))), lambda x: x["country"])
    media = seen.groupBy(EDITION, "cluster_key").agg(F.array_join(ordered, ", ").alias("media_countries"))
    event = F.col("event") if "event" in notes.columns else F.lit(None).cast("string")
    titles = notes.select(F.col("seq").alias("first_seq"), F.coalesce(event, F.col("title")).alias("title"))
    wires = wire_summary(notes).select(EDITION, "cluster_key", "wires")
    return (
        clusters.join(media, [EDITION, "cluster_key"]).join(wires, [EDITION, "cluster_key"], "left")
        .join(titles, "first_seq")
        .withColumn("wires", F.coalesce("wires", F.lit("")))
    )


def with_cluster_metrics(notes: DataFrame) -> DataFrame:
    """Story metrics on every note. Only stories of several notes are joined; a lone note's are known."""
    shared = story_clusters(notes).where(F.col("notes") > 1).select(
        EDITION, "cluster_key", F.col("sources").alias("_s"), F.col("countries").alias("_c"),
        F.col("voices").alias("_v"), F.col("weight").alias("_w"),
    )
    one = F.lit(1).cast("bigint")
    alone = F.when(F.col("wire").isNull(), F.lit(3)).otherwise(F.lit(1)).cast("bigint")
    return notes.join(shared, [EDITION, "cluster_key"], "left").withColumns({
        "cluster_sources": F.coalesce("_s", one), "cluster_countries": F.coalesce("_c", one),
        "cluster_voices": F.coalesce("_v", one), "weight": F.coalesce("_w", alone),
    }).drop("_s", "_c", "_v", "_w")


def coverage_note(sources: Column, countries: Column, voices: Column) -> Column:
    """Annotation of a note whose story other outlets carry too."""
    text = F.concat(
        F.lit(" [cobertura: "), sources.cast("string"), F.lit(" medios, "), countries.cast("string"),
        F.lit(" país(es), "), voices.cast("string"), F.lit(" fuentes independientes]"),
    )
    return F.when(sources > 1, text).otherwise(F.lit(""))


def region_ranking(notes: DataFrame) -> DataFrame:
    """Notes of each region in an edition, heaviest story first, with their coverage annotation."""
    measured = staged(with_cluster_metrics(notes))
    ranked = sliced_row_number(measured, [EDITION, "region"], [("weight", False), ("seq", True)], "region_rank")
    return ranked.withColumn(
        "coverage", coverage_note(F.col("cluster_sources"), F.col("cluster_countries"), F.col("cluster_voices"))
    )


def top_cross(notes: DataFrame, n: int = 5) -> DataFrame:
    """The n heaviest stories with several outlets in each edition: the opening of a report."""
    shared = staged(story_clusters(notes).where(F.col("sources") > 1))  # numbering reads it several times
    return sliced_row_number(shared, [EDITION], [("weight", False), ("first_seq", True)], "cross_rank", limit=n)


def validate_groups(groups: Column, n_items: Column) -> Column:
    """Usable groups of a response as array of (event, items): known numbers, each in its first group, at least two.

    A number is taken by the first group that names it, even when that group is dropped later for its size.
    """
    tagged = F.flatten(F.transform(groups, lambda g, gi: F.transform(
        F.filter(F.coalesce(g["items"], F.array().cast("array<int>")), lambda n: (n >= 1) & (n <= n_items)),
        lambda n: F.struct(gi.alias("g"), n.alias("n")),
    )))
    first = let(tagged, lambda ts: F.filter(
        ts, lambda x, i: ~F.exists(F.slice(ts, F.lit(1), i), lambda y: y["n"] == x["n"])
    ))
    kept = let(first, lambda fs: F.transform(groups, lambda g, gi: F.struct(
        F.trim(g["event"]).alias("event"),
        F.transform(F.filter(fs, lambda x: x["g"] == gi), lambda x: x["n"]).alias("items"),
    )))
    return F.filter(kept, lambda g: F.size(g["items"]) >= 2)


def citation_numbers(notes: DataFrame) -> DataFrame:
    """1-based number of each note in its edition, in input order."""
    return sliced_row_number(notes, [EDITION], [("seq", True)], "n")


def link_dedup(notes: DataFrame) -> DataFrame:
    """First note of every link in an edition; notes without a link drop out.

    The first position is found by aggregation, which combines repeats before the shuffle; the rows themselves then
    meet it on their unique position.
    """
    linked = notes.withColumn("_link", F.trim("link")).where(F.col("_link") != "")
    first = linked.groupBy(EDITION, "_link").agg(F.min("seq").alias("seq")).select("seq")
    return linked.drop("_link").join(first, "seq", "left_semi")


def news_links_section(notes: DataFrame, region_order: Column | None = None) -> DataFrame:
    """The published news list as rows: by edition, region, country, outlet and order of appearance."""
    order = F.col("region") if region_order is None else region_order
    return link_dedup(notes).orderBy(EDITION, order, "country", "name", "seq")
