"""Structure of Markdown reports, one report per row: sections, links, citations and claims.

Every function works inside the row, so reports spread over partitions freely and no line state needs a window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from newslens.functions.binding import let
from newslens.functions.regions import EMPTY_REGION, REGION_ORDER, region_label
from newslens.functions.text import NEWS_HEADING, array_of, strip

# Headings a complete report has, and section names with rules of their own.
REQUIRED_HEADINGS = [
    "## Resumen ejecutivo",
    "## Resumen por región",
    "## Clima internacional",
    "## Empresas potencialmente afectadas",
]
ABSTRACT_HEADING = "## Resumen ejecutivo"
REGIONS_HEADING = "## Resumen por región"
NEWS_SECTION = "Noticias utilizadas"
PROSE_SECTIONS = ["Resumen ejecutivo", "Resumen por región"]
STATUS_LINES = ["Sin novedades", "Cobertura insuficiente", "_Cobertura parcial"]

# Patterns of links, citations and news lines in a report.
MD_LINK = r'!?\[([^\]]*)\]\(([^)\s]*)(?:\s+"[^"]*")?\)'
AUTO_LINK = r"<(https?://[^>\s]+)>"
BARE_LINK = r"https?://[^\s<>()\[\]]+"
ANY_LINK = f"{MD_LINK}|{AUTO_LINK}|{BARE_LINK}"
CITATION = r"\[\d+(?:\s*,\s*\d+)*+\]\(?"
RESOLVED = r"\[\[(\d+)\]\]\(<([^>]*)>\)"
NEWS_LINE = r"^- \[(.+)\]\(<(.+?)>\) — (.+) \(([^()]+)\)$"

_PART = "struct<heading:string,body:string>"


def _parts(text: Column, mark: str) -> Column:
    """Blocks that start at a heading line with `mark`; text before the first one is left out."""
    blocks = F.split(F.concat(F.lit("\n"), text), rf"\n{mark} (?=[^\n])")

    def part(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        return F.struct(strip(head).alias("heading"), strip(F.substr(block, F.length(head) + 1)).alias("body"))

    return F.transform(F.slice(blocks, 2, F.size(blocks)), part)


def sections(md: Column) -> Column:
    """`## ` sections in order, as array of (heading, body)."""
    return _parts(md, "##")


def subsections(body: Column) -> Column:
    """`### ` parts of a section in order, as array of (heading, body)."""
    return _parts(body, "###")


def last_per_heading(parts: Column) -> Column:
    """Keeps the last of the parts that share a heading."""

    def last_only(ps: Column) -> Column:
        later = lambda i: F.slice(ps, i + F.lit(2), F.size(ps))
        return F.filter(ps, lambda p, i: ~F.exists(later(i), lambda q: q["heading"] == p["heading"]))

    return let(parts, last_only)


def section_body(md: Column, heading: str) -> Column:
    """Body of the last section with this heading; NULL when the report has none."""
    hits = F.filter(sections(md), lambda s: s["heading"] == heading)
    return F.try_element_at(hits, F.lit(-1))["body"]


def report_complete(md: Column) -> Column:
    """All required headings are present."""
    return F.forall(array_of(REQUIRED_HEADINGS), lambda h: F.contains(md, h))


def normalize_headings(md: Column) -> Column:
    """Required sections written with one `#` get two; separator lines are dropped."""

    def line(x: Column) -> Column:
        deeper = F.concat(F.lit("#"), strip(x))
        known = F.exists(array_of(REQUIRED_HEADINGS), lambda h: F.startswith(deeper, h))
        return F.when(F.startswith(strip(x), F.lit("# ")) & known, deeper).otherwise(x)

    kept = F.filter(F.split(md, "\n"), lambda x: strip(x) != "---")
    return F.array_join(F.transform(kept, line), "\n")


def split_abstract(md: Column) -> Column:
    """(abstract, body): the opening summary, only when the report starts with it."""
    start = F.regexp_replace(md, r"^\s+", "")
    after = F.substr(start, F.lit(len(ABSTRACT_HEADING) + 1))
    at = F.position(F.lit("\n## "), after)
    abstract = strip(F.when(at == 0, after).otherwise(F.left(after, at - 1)))
    body = F.when(at == 0, F.lit("")).otherwise(F.substr(after, at + 1))
    found = F.startswith(start, F.lit(ABSTRACT_HEADING)) & (abstract != "")
    return F.struct(F.when(found, abstract).alias("abstract"), F.when(found, body).otherwise(md).alias("body"))


def news_block(md: Column) -> Column:
    """The news list from its heading to the end; NULL when there is none."""
    at = F.position(F.lit("\n" + NEWS_HEADING), md)
    return F.when(at > 0, F.substr(md, at + 1))


def news_link_count(md: Column) -> Column:
    """Entries in the news list."""
    return F.coalesce(F.regexp_count(news_block(md), F.lit(r"(?md)^- \[")), F.lit(0))


def allowed_set(md: Column) -> Column:
    """Distinct URLs a report links to, in any form."""
    matches = F.regexp_extract_all(md, F.lit(ANY_LINK), F.lit(0))
    return F.array_distinct(F.transform(matches, link_target))


def link_target(token: Column) -> Column:
    """URL of one link token."""
    return (
        F.when(token.rlike(r"^!?\["), F.regexp_extract(token, MD_LINK, 2))
        .when(F.startswith(token, F.lit("<")), F.regexp_extract(token, AUTO_LINK, 1))
        .otherwise(token)
    )


def replaced(md: Column, pattern: str, token: Callable[[Column], Column], nothing: Column) -> Column:
    """Array of `token` for each match of a pattern, its `out` with the text before it in front, and `nothing` for the text after the last.

    The text between two matches stays in one piece, so the work per match does not depend on it.
    """

    def piece(gap: Column, t: Column) -> Column:
        return let(F.coalesce(F.when(t.isNotNull(), token(t)), nothing), lambda x: x.withField("out", F.concat(gap, x["out"])))

    return F.zip_with(F.split(md, pattern, -1), F.regexp_extract_all(md, F.lit(pattern), F.lit(0)), piece)


def strip_unknown_links(md: Column, allowed: Column) -> Column:
    """Array of (out, removed) tokens: links outside `allowed` become their text, images and bare URLs go."""
    known = F.coalesce(allowed, F.array().cast("array<string>"))

    def token(t: Column) -> Column:
        image = F.startswith(t, F.lit("!"))
        markdown = t.rlike(r"^!?\[")
        keep = F.array_contains(known, link_target(t)) & ~image
        text = F.when(markdown & ~image, F.regexp_extract(t, MD_LINK, 1)).otherwise(F.lit(""))
        return F.struct(F.when(keep, t).otherwise(text).alias("out"), (~keep).cast("int").alias("removed"))

    return replaced(md, ANY_LINK, token, F.struct(F.lit("").alias("out"), F.lit(0).alias("removed")))


def cited_numbers(md: Column) -> Column:
    """Distinct note numbers a report cites and that are not yet links; a number too large for any edition is left out."""
    tokens = F.regexp_extract_all(md, F.lit(CITATION), F.lit(0))
    open_only = F.filter(tokens, lambda t: ~F.endswith(t, F.lit("(")))
    numbers = F.transform(open_only, lambda t: F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0)))
    return F.array_distinct(F.array_compact(F.transform(F.flatten(numbers), lambda n: n.try_cast("bigint"))))


def resolve_citations(md: Column, links: Column) -> Column:
    """Array of (out, resolved, invalid) tokens: `[n]` becomes a link to note n, unknown numbers go.

    `links` maps the numbers of existing notes to their link, which may be empty.
    """

    def token(t: Column) -> Column:
        cite = ~F.endswith(t, F.lit("("))
        numbers = F.transform(F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("bigint"))
        known = F.filter(numbers, lambda n: F.try_element_at(links, n).isNotNull())

        def shown(n: Column) -> Column:
            url = F.try_element_at(links, n)
            label = F.concat(F.lit("["), n.cast("string"), F.lit("]"))
            return F.when(url == "", label).otherwise(
                F.concat(F.lit("["), label, F.lit("](<"), url, F.lit(">)"))
            )

        hits = F.when(cite, F.size(known)).otherwise(0)
        return F.struct(
            F.when(cite, F.array_join(F.transform(known, shown), "")).otherwise(t).alias("out"),
            hits.alias("resolved"),
            (F.when(cite, F.size(numbers)).otherwise(0) - hits).alias("invalid"),
        )

    return replaced(md, CITATION, token, F.struct(F.lit("").alias("out"), F.lit(0).alias("resolved"), F.lit(0).alias("invalid")))


def token_text(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t["out"]), "")


def token_sum(tokens: Column, field: str) -> Column:
    return F.aggregate(tokens, F.lit(0), lambda acc, t: acc + t[field])


def body_lines(md: Column) -> Column:
    """Array of (section, text): the trimmed lines that say something, outside headings and the news list."""
    blocks = F.split(F.concat(F.lit("\n"), md), r"\n[ \t\r\f]*## (?=[^\n]*\S)")

    def said(section: Column, rest: Column) -> Column:
        lines = F.when(section != NEWS_SECTION, F.transform(F.split(rest, "\n"), strip))
        kept = F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
        return F.transform(kept, lambda x: F.struct(section.alias("section"), x.alias("text")))

    def block(b: Column, i: Column) -> Column:
        head = F.when(i == 0, F.lit("")).otherwise(F.substring_index(b, "\n", 1))
        cut = let(head, lambda h: F.struct(strip(h).alias("section"), F.substr(b, F.length(h) + 1).alias("rest")))
        return let(cut, lambda c: said(c["section"], c["rest"]))

    return F.flatten(F.transform(blocks, block))


def count_uncited(md: Column) -> Column:
    """Bullets, and prose in the two summaries, that carry no resolved citation."""

    def uncited(line: Column) -> Column:
        x = line["text"]
        status = F.exists(array_of(STATUS_LINES), lambda s: F.startswith(x, s))
        bullet = F.startswith(x, F.lit("- ")) | F.startswith(x, F.lit("* "))
        return ~status & (bullet | line["section"].isin(PROSE_SECTIONS)) & ~F.contains(x, F.lit("[["))

    return F.size(F.filter(body_lines(md), uncited))


def claim_text(line: Column) -> Column:
    """A line without its resolved citations and bullet."""
    t = strip(F.regexp_replace(line, RESOLVED, ""))
    return F.regexp_replace(F.regexp_replace(t, r"^- ", ""), r"^\* ", "")


def claim_numbers(line: Column) -> Column:
    """Distinct note numbers of the resolved citations, in order."""
    found = F.regexp_extract_all(line, F.lit(RESOLVED), F.lit(1))
    return F.array_distinct(F.transform(found, lambda n: n.cast("bigint")))


def claim_links(line: Column) -> Column:
    """Links of the resolved citations, in order."""
    return F.regexp_extract_all(line, F.lit(RESOLVED), F.lit(2))


def _regions_span(md: Column) -> tuple[Column, Column]:
    """Start of the summary by region (0 when there is none) and the position just after its end."""
    start = F.position(F.lit(REGIONS_HEADING), md)
    after = F.position(F.lit("\n## "), md, start + len(REGIONS_HEADING))
    return start, F.when(after == 0, F.length(md) + 1).otherwise(after)


def absent_regions(md: Column) -> Column:
    """Region ids, in editorial order, without a subsection of their own in the summary by region."""
    start, end = _regions_span(md)
    body = F.when(start == 0, F.lit("")).otherwise(F.substr(md, start, end - start))
    found = F.transform(subsections(body), lambda s: s["heading"])
    return let(found, lambda f: F.filter(array_of(REGION_ORDER), lambda r: ~F.array_contains(f, region_label(r))))


def fill_regions(md: Column, absent: Column, texts: Column) -> Column:
    """Adds a subsection for each absent region at the end of the summary by region.

    `texts` maps a region id to the line to show; a region it does not know gets the "no news" line.
    """
    start, end = _regions_span(md)

    def block(r: Column) -> Column:
        line = F.coalesce(F.try_element_at(texts, r), F.lit(EMPTY_REGION))
        return F.concat(F.lit("\n### "), region_label(r), F.lit("\n\n"), line, F.lit("\n"))

    repair = F.array_join(F.transform(absent, block), "")
    return F.when(start == 0, md).otherwise(F.concat(F.left(md, end - 1), repair, F.substr(md, end)))
