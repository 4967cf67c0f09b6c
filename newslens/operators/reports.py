"""Published reports as data. A report is a row (report_id, edition_date, markdown)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.functions import markdown as md
from newslens.functions.regions import EMPTY_REGION, region_label, region_rank
from newslens.functions.text import escape_link_text, reading_minutes, strip, truncate
from newslens.functions.wires import source_kind
from newslens.operators.coverage import edition_coverage
from newslens.operators.stories import citation_numbers, cross_coverage, region_ranking
from newslens.session import staged

KEYS = ["report_id", "edition_date"]

# Claims per verification request, snippet length in its evidence, verdicts.
CLAIM_BATCH = 30
EVIDENCE_SNIPPET = 500
SUPPORTED, INFERENCE = "respaldada", "inferencia"


def section_rows(reports: DataFrame, keep: str = "all") -> DataFrame:
    """(section_no, heading, body) per report; with keep='last' a repeated heading counts once, by its last section."""
    parts = md.sections(F.col("markdown"))
    parts = md.last_per_heading(parts) if keep == "last" else parts
    return reports.select(*KEYS, F.posexplode(parts).alias("section_no", "_s")).select(
        *KEYS, (F.col("section_no") + 1).alias("section_no"), "_s.heading", "_s.body"
    )


def subsection_rows(reports: DataFrame) -> DataFrame:
    """(section, sub_no, heading, body): the parts of every section."""
    parts = section_rows(reports).select(
        *KEYS, "section_no", F.col("heading").alias("section"), F.posexplode(md.subsections(F.col("body"))).alias("sub_no", "_s")
    )
    return parts.select(*KEYS, "section_no", "section", (F.col("sub_no") + 1).alias("sub_no"), "_s.heading", "_s.body")


def split_regions(reports: DataFrame) -> DataFrame:
    """Regions of the summary by region, each marked as empty or not and as thinly covered or not."""
    body = md.section_body(F.col("markdown"), md.REGIONS_HEADING[3:])
    return (
        reports.select(*KEYS, F.posexplode(md.subsections(body)).alias("sub_no", "_s"))
        .select(*KEYS, (F.col("sub_no") + 1).alias("sub_no"), F.col("_s.heading").alias("region"), F.col("_s.body").alias("body"))
        .withColumn("empty", strip(F.col("body")) == EMPTY_REGION)
        .withColumn("insufficient", F.startswith("body", F.lit("Cobertura insuficiente")))
    )


def news_links(reports: DataFrame) -> DataFrame:
    """(region, title, url, outlet, country) of every entry in the news lists."""
    parts = F.split(md.news_block(F.col("markdown")), r"\n[ \t\r\f]*### ")
    part = reports.select(*KEYS, F.posexplode(F.slice(parts, 2, F.size(parts))).alias("group_no", "_p"))
    lines = part.select(
        *KEYS, "group_no", strip(F.substring_index("_p", "\n", 1)).alias("region"),
        F.posexplode(F.transform(F.split("_p", "\n"), strip)).alias("line_no", "_line"),
    ).where((F.col("line_no") > 0) & F.col("_line").rlike(md.NEWS_LINE))
    field = lambda i: F.regexp_extract("_line", md.NEWS_LINE, i)
    return lines.select(
        *KEYS, "group_no", "line_no", "region",
        F.regexp_replace(field(1), r"\\([\[\]])", "$1").alias("title"),
        field(2).alias("url"), field(3).alias("outlet"), field(4).alias("country"),
    )


def reading_time(reports: DataFrame) -> DataFrame:
    return reports.select(*KEYS, reading_minutes(F.col("markdown")).alias("minutes"))


def missing_regions(reports: DataFrame) -> DataFrame:
    """(region) rows for the editorial regions a report leaves out."""
    return reports.select(*KEYS, F.explode(md.absent_regions(F.col("markdown"))).alias("region"))


def fill_missing_regions(reports: DataFrame, coverage: DataFrame) -> DataFrame:
    """Reports with a subsection for every region; `coverage` has (edition_date, region, empty_text)."""
    texts = coverage.groupBy("edition_date").agg(
        F.map_from_entries(F.collect_list(F.struct("region", "empty_text"))).alias("_texts")
    )
    filled = md.fill_regions(F.col("markdown"), md.absent_regions(F.col("markdown")), F.coalesce("_texts", F.create_map().cast("map<string,string>")))
    # One row per edition: written out, its measured size lets it go to the reports instead of moving them.
    return reports.join(staged(texts), "edition_date", "left").withColumn("markdown", filled).select(*KEYS, "markdown")


def link_targets(reports: DataFrame) -> DataFrame:
    """Distinct (report, url) pairs."""
    return reports.select(*KEYS, F.explode(md.allowed_set(F.col("markdown"))).alias("url"))


def known_links(reports: DataFrame, notes: DataFrame, how: str = "left_semi") -> DataFrame:
    """Links in reports that belong (left_semi) or do not belong (left_anti) to a note of the same edition."""
    links = notes.select("edition_date", F.trim("link").alias("url")).where(F.col("url") != "").distinct()
    return link_targets(reports).join(links, ["edition_date", "url"], how)


def strip_unknown_links(reports: DataFrame, notes: DataFrame) -> DataFrame:
    """Reports without links to anything but the notes of their edition, and how many were removed.

    Only (report, url) pairs meet the notes; each report then gets back the few links it may keep.
    """
    keep = known_links(reports, notes).groupBy("report_id").agg(F.collect_set("url").alias("_keep"))
    tokens = md.strip_unknown_links(F.col("markdown"), F.col("_keep"))
    return reports.join(keep, "report_id", "left").select(*KEYS, tokens.alias("_tokens")).select(
        *KEYS, md.token_text(F.col("_tokens")).alias("markdown"), md.token_sum(F.col("_tokens"), "removed").alias("removed")
    )


def numbered_links(notes: DataFrame) -> DataFrame:
    """(edition_date, n, link) of the notes a citation can name."""
    numbered = citation_numbers(notes.select("edition_date", "seq", "link"))
    return numbered.select("edition_date", "n", F.trim(F.coalesce("link", F.lit(""))).alias("link"))


def citation_lookup(reports: DataFrame, notes: DataFrame) -> DataFrame:
    """Each distinct number a report cites with the link of its note; NULL for a number without a note."""
    cited = reports.select(*KEYS, F.explode(md.cited_numbers(F.col("markdown"))).alias("n"))
    return cited.join(numbered_links(notes), ["edition_date", "n"], "left")


def resolve_citations(reports: DataFrame, notes: DataFrame) -> DataFrame:
    """Reports with `[n]` turned into links, with resolved, invalid and uncited counts."""
    found = citation_lookup(reports, notes).where(F.col("link").isNotNull())
    links = found.groupBy("report_id").agg(F.map_from_entries(F.collect_list(F.struct("n", "link"))).alias("_links"))
    none = F.create_map().cast("map<bigint,string>")
    tokens = md.resolve_citations(F.col("markdown"), F.coalesce("_links", none))
    return (
        reports.join(links, "report_id", "left").select(*KEYS, tokens.alias("_tokens"))
        .select(
            *KEYS, md.token_text(F.col("_tokens")).alias("markdown"),
            md.token_sum(F.col("_tokens"), "resolved").alias("resolved"),
            md.token_sum(F.col("_tokens"), "invalid").alias("invalid"),
        )
        .withColumn("uncited", md.count_uncited(F.col("markdown")))
    )


def citation_stats(resolved: DataFrame) -> DataFrame:
    """Citation totals per edition."""
    return resolved.groupBy("edition_date").agg(*[F.sum(c).alias(c) for c in ("resolved", "invalid", "uncited")])


def claims(resolved: DataFrame) -> DataFrame:
    """Cited statements: (claim_no, section, text, nums, links), numbered from 0 within the report."""
    cited = F.filter(md.body_lines(F.col("markdown")), lambda x: x["text"].rlike(md.RESOLVED))
    rows = resolved.select(*KEYS, F.posexplode(cited).alias("claim_no", "_c"))
    return rows.select(
        *KEYS, "claim_no", "_c.section", md.claim_text(F.col("_c.text")).alias("text"),
        md.claim_numbers(F.col("_c.text")).alias("nums"), md.claim_links(F.col("_c.text")).alias("links"),
    )


def claim_batches(claim_rows: DataFrame, size: int = CLAIM_BATCH) -> DataFrame:
    """Adds batch_no and the 1-based id in the batch."""
    return claim_rows.withColumns({
        "batch_no": F.floor(F.col("claim_no") / size).cast("int"), "id": F.col("claim_no") % size + 1,
    })


def evidence_bundle(batched: DataFrame, notes: DataFrame) -> DataFrame:
    """Verification text per batch of claims: each claim followed by the notes it cites."""
    kind = source_kind(F.col("ownership"), F.col("ownership_note"))
    rest = F.concat(
        F.lit("] — "), F.col("name"), F.lit(" ("), F.col("country"), F.lit(", medio "), kind, F.lit("): "), F.col("title"), F.lit(" — "),
        truncate(F.col("snippet"), EVIDENCE_SNIPPET), F.lit("\n"),
    )
    numbered = citation_numbers(notes.select("edition_date", "seq", rest.alias("_rest")))
    evidence = numbered.select("edition_date", "n", F.concat(F.lit("  Nota ["), F.col("n").cast("string"), "_rest").alias("_note"))
    batch = [*KEYS, "batch_no"]
    held = batched.where(F.col("nums").isNotNull())
    # Numbers alone meet the notes; the texts of claims join the result once.
    cited = held.select(*batch, "id", F.posexplode("nums").alias("_pos", "n")).join(evidence, ["edition_date", "n"], "left")
    notes_of = cited.select(*batch, "id", (F.col("_pos") + 1).alias("_pos"), F.coalesce("_note", F.lit("")).alias("_line"))
    title = F.concat(
        F.lit("AFIRMACIÓN "), F.col("id").cast("string"), F.lit(" (sección "), F.col("section"), F.lit("):\n"), F.col("text"), F.lit("\n")
    )
    ends = F.array(
        F.struct(F.lit(0).alias("_pos"), title.alias("_line")), F.struct((F.size("nums") + 1).alias("_pos"), F.lit("\n").alias("_line"))
    )
    claims_of = held.select(*batch, "id", F.inline(ends))
    ordered = F.array_sort(F.collect_list(F.struct("id", "_pos", "_line")))
    return (
        claims_of.unionByName(notes_of)
        .groupBy(*batch).agg(F.array_join(F.transform(ordered, lambda x: x["_line"]), "").alias("evidence"))
    )


def verdict_join(batched: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Claims with their verdict; NULL where the batch or the claim got none. The last verdict of an id counts."""
    last = verdicts.groupBy("report_id", "batch_no", "id").agg(
        F.max_by(F.struct("verdict", "problem"), "pos").alias("_v")
    )
    return batched.join(last, ["report_id", "batch_no", "id"], "left").select(
        *batched.columns, "_v.verdict", "_v.problem"
    )


def fidelity_counts(judged: DataFrame) -> DataFrame:
    """Verdicts per edition; a verdict outside the known ones counts as unsupported."""
    v = F.col("verdict")
    known = v.isNotNull()
    return judged.groupBy("edition_date").agg(
        F.count_if(known).alias("checked"), F.count_if(v == SUPPORTED).alias("supported"),
        F.count_if(v == INFERENCE).alias("inference"),
        F.count_if(known & ~v.isin(SUPPORTED, INFERENCE)).alias("unsupported"),
    )


def news_list_lines(notes: DataFrame) -> DataFrame:
    """Markdown line of each entry of the news list."""
    line = F.concat(
        F.lit("- ["), escape_link_text(F.col("title")), F.lit("](<"), F.col("link"), F.lit(">) — "),
        F.col("name"), F.lit(" ("), F.col("country"), F.lit(")"),
    )
    return notes.withColumn("line", line)


def digest_numbers(notes: DataFrame) -> DataFrame:
    """(seq, n): the number a note goes by in the digest. Notes of one source with one title go by the last of their numbers."""
    same = ["edition_date", "source_id", "title"]
    numbered = citation_numbers(notes.select(*same, "seq"))
    last = numbered.groupBy(*[F.col(c).alias(f"_{c}") for c in same]).agg(F.max("n").alias("n"))
    agree = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]
    return numbered.drop("n").join(last, reduce(and_, agree)).select("seq", "n")


def digest_input(notes: DataFrame, outlets: DataFrame, headlines: DataFrame) -> DataFrame:
    """What a report is written from, as ordered lines (edition_date, block, position, line_no, text).

    Blocks: 0 stories several outlets carry, 1 the note numbers of those stories, 2 regions with their notes. It stays
    in rows, sorted at the sink, so an edition of any size never has to fit into one value.
    """
    numbers = digest_numbers(notes)
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    num = lambda c: F.col(c).cast("string")

    cross = staged(cross_coverage(notes))
    wires = F.when(F.col("wires") != "", text(" (cables: ", F.col("wires"), ")")).otherwise(F.lit(""))
    cross_lines = cross.select(
        "edition_date", F.lit(0).alias("block"), F.col("rank").alias("position"), F.lit(0).cast("bigint").alias("line_no"),
        text("- ", F.col("title"), " — ", num("sources"), " medios en ", num("countries"), " país(es) (",
             F.col("media_countries"), "); fuentes independientes: ", num("voices"), ", de ", num("voice_countries"),
             " país(es)", wires).alias("text"),
    )
    refs = notes.select("edition_date", "cluster_key", "seq").join(
        cross.select("edition_date", "cluster_key", "rank"), ["edition_date", "cluster_key"]
    ).join(numbers, "seq").select(
        "edition_date", F.lit(1).alias("block"), F.col("rank").alias("position"), F.col("n").alias("line_no"),
        text("[", num("n"), "]").alias("text"),
    )
    coverage = staged(edition_coverage(outlets, headlines)).withColumn("position", region_rank(F.col("region")).cast("bigint"))
    heads = coverage.select(
        "edition_date", F.lit(2).alias("block"), "position", F.lit(-1).cast("bigint").alias("line_no"),
        text("REGIÓN: ", region_label(F.col("region")), " (respondieron hoy ", num("responded"), " de ", num("configured"),
             " medios)").alias("text"),
    )
    with_notes = notes.select("edition_date", "region").distinct().withColumn("_has", F.lit(True))
    covered = coverage.join(with_notes, ["edition_date", "region"], "left")
    states = covered.select(
        "edition_date", F.lit(2).alias("block"), "position", F.lit(0).cast("bigint").alias("line_no"),
        F.when(F.col("_has").isNull(), F.col("empty_text")).when(
            F.col("low"), text("_Cobertura parcial: respondieron ", num("responded"), " de ", num("configured"), " medios de la región._")
        ).alias("text"),
    ).where(F.col("text").isNotNull())
    listed = lambda c: text("[", F.array_join(F.col(c), " "), "]")
    note_lines = region_ranking(notes).join(numbers, "seq").select(
        "edition_date", F.lit(2).alias("block"), region_rank(F.col("region")).cast("bigint").alias("position"),
        F.col("region_rank").alias("line_no"),
        text("- [", num("n"), "] [", F.col("country"), " | ", F.col("name"), " | ", F.col("stance"), " | tipo: ",
             source_kind(F.col("ownership"), F.col("ownership_note")), "] ", F.col("title"), " (países: ", listed("countries"),
             ", empresas: ", listed("companies"), ", relación: ", F.col("relation_type"), ")", F.col("coverage")).alias("text"),
    )
    return cross_lines.unionByName(refs).unionByName(heads).unionByName(states).unionByName(note_lines)
