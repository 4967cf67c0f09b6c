"""Feed payloads: RSS 2.0, Atom and RDF bodies to headline rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.functions.text import MAX_SNIPPET, MAX_TITLE, clean_link, clean_text, parse_pubdate
from newslens.operators.headlines import MAX_PER_SOURCE

# Payload size limit and the charsets read as Latin-1.
MAX_BODY = 10 << 20
LATIN_CHARSETS = ["iso-8859-1", "latin1", "windows-1252", "us-ascii"]

_TEXT = "array<struct<_VALUE:string>>"
_LINKS = "array<struct<_VALUE:string,_href:string,_rel:string>>"
_ITEM = f"struct<title:{_TEXT},link:{_LINKS},guid:{_TEXT},description:{_TEXT},pubDate:{_TEXT},date:{_TEXT}>"
_ENTRY = f"struct<title:{_TEXT},link:{_LINKS},summary:{_TEXT},content:{_TEXT},published:{_TEXT},updated:{_TEXT}>"
_FEED = f"channel struct<item:array<{_ITEM}>>, entry array<{_ENTRY}>, item array<{_ITEM}>"


def read_payloads(spark: SparkSession, path: str, max_body: int = MAX_BODY) -> DataFrame:
    """Landed payload files (source_id, fetched_at, body, rejected); the file name up to the first dot is the source."""
    files = spark.read.format("binaryFile").load(path)
    return mark_rejected(files.select(
        F.split_part(F.element_at(F.split("path", "/"), -1), F.lit("."), F.lit(1)).alias("source_id"),
        F.col("modificationTime").alias("fetched_at"), F.col("content").alias("body"),
    ), max_body)


def mark_rejected(payloads: DataFrame, max_body: int = MAX_BODY) -> DataFrame:
    return payloads.withColumn("rejected", F.octet_length("body") > max_body)


def charset(body: Column) -> Column:
    """Encoding named in the XML prolog, lower case; empty when none is."""
    # The pattern stops at the end of the prolog, however long that is.
    return F.lower(F.regexp_extract(F.decode(body, "ISO-8859-1"), r"""^\s*(?:\x{EF}\x{BB}\x{BF})?<\?xml[^>]*encoding=["']([A-Za-z0-9._-]+)["']""", 1))


def decode_body(body: Column) -> Column:
    """Payload as text; NULL for a charset that is not supported or bytes that do not fit it."""
    name = charset(body)
    utf8 = body.cast("string")
    return F.when(name.isin(LATIN_CHARSETS), F.decode(body, "ISO-8859-1")).when(
        name.isin("", "utf-8") & F.is_valid_utf8(utf8), utf8
    )


def _last(c: Column) -> Column:
    """Text of the last of repeated elements; the empty string when there is none."""
    return F.coalesce(F.try_element_at(c, F.lit(-1))["_VALUE"], F.lit(""))


def _or_else(first: Column, second: Column) -> Column:
    return F.when(first == "", second).otherwise(first)


def _items(feed: Column) -> Column:
    """Items of the first format that has any, in one shape."""

    def item(i: Column, guid: Column, date: Column) -> Column:
        return F.struct(
            _last(i["title"]).alias("title"), i["link"].alias("links"), guid.alias("guid"),
            _last(i["description"]).alias("snippet"), date.alias("date"), F.lit(False).alias("atom"),
        )

    def entry(e: Column) -> Column:
        return F.struct(
            _last(e["title"]).alias("title"), e["link"].alias("links"), F.lit("").alias("guid"),
            _or_else(_last(e["summary"]), _last(e["content"])).alias("snippet"),
            _or_else(_last(e["published"]), _last(e["updated"])).alias("date"), F.lit(True).alias("atom"),
        )

    rss, atom, rdf = feed["channel"]["item"], feed["entry"], feed["item"]
    return (
        F.when(F.size(rss) > 0, F.transform(rss, lambda i: item(i, _last(i["guid"]), _last(i["pubDate"]))))
        .when(F.size(atom) > 0, F.transform(atom, entry))
        .when(F.size(rdf) > 0, F.transform(rdf, lambda i: item(i, F.lit(""), _last(i["date"]))))
    )


def pick_link(links: Column, guid: Column, atom: Column) -> Column:
    """Link of an item: its first usable text, else its first usable href, else its guid.

    An Atom entry uses the first link that is the page itself (no rel, or rel alternate).
    """
    usable = lambda field: F.try_element_at(
        F.filter(F.transform(links, lambda x: clean_link(F.coalesce(x[field], F.lit("")))), lambda u: u != ""), F.lit(1)
    )
    own = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("")).isin("", "alternate"))
    page = clean_link(F.coalesce(F.try_element_at(own, F.lit(1))["_href"], F.lit("")))
    return F.when(atom, page).otherwise(F.coalesce(usable("_VALUE"), usable("_href"), clean_link(guid)))


def parse_feeds(payloads: DataFrame, max_items: int | None = MAX_PER_SOURCE, keys: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Headlines (keys, feed_pos, title, link, snippet, published_at) of every readable payload, at most
    `max_items` of each (None: all). One XML pass reads all three formats; the cap is a slice of the payload's own items."""
    text = F.when(~F.col("rejected"), decode_body(F.col("body")))
    parsed = payloads.select(*keys, F.from_xml(text, _FEED, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}).alias("_feed"))
    items = _items(F.col("_feed"))
    rows = parsed.select(*keys, F.posexplode(items if max_items is None else F.slice(items, 1, max_items)).alias("_pos", "_i"))
    return rows.select(
        *keys, (F.col("_pos") + 1).alias("feed_pos"), clean_text(F.col("_i.title"), MAX_TITLE).alias("title"),
        pick_link(F.col("_i.links"), F.col("_i.guid"), F.col("_i.atom")).alias("link"),
        clean_text(F.col("_i.snippet"), MAX_SNIPPET).alias("snippet"), parse_pubdate(F.col("_i.date")).alias("published_at"),
    )


def feed_failures(payloads: DataFrame, parsed: DataFrame, keys: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Payloads that gave no headline, with the reason."""
    detail = F.when(F.col("rejected"), "payload too large").when(
        decode_body(F.col("body")).isNull(), "unsupported charset"
    ).otherwise("feed did not parse as RSS2, Atom or RDF")
    seen = parsed.select(*keys).distinct()
    return payloads.join(seen, list(keys), "left_anti").select(*keys, detail.alias("detail"))


def feed_smoke(outlets: DataFrame, parsed: DataFrame) -> DataFrame:
    """Liveness of each outlet's feed (ok, failed or skipped) with the title of its first headline."""
    first = parsed.groupBy("source_id").agg(F.min_by("title", F.struct(*[c for c in parsed.columns if c in ("edition_date", "fetch_no", "feed_pos")])).alias("sample"))
    state = F.when(~F.col("has_feed"), "skipped").when(F.col("sample").isNull(), "failed").otherwise("ok")
    return outlets.join(first, "source_id", "left").select(
        "source_id", state.alias("state"), F.when(F.col("has_feed"), F.col("sample")).alias("sample")
    )


def smoke_totals(smoke: DataFrame) -> DataFrame:
    return smoke.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in ("ok", "failed", "skipped")]
    )
