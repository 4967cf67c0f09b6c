"""The engine's inputs as views over the supplied tables. `oracle.py` states the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.functions.binding import bind
from newslens.functions.regions import REGION_LABELS
from newslens.functions.text import MAX_SNIPPET, MAX_TITLE, array_of, clean_link, clean_text, collapse, escape_link_text
from newslens.functions.wires import ascii_word
from newslens.operators import audit, scoring, stories, tagging
from newslens.operators.numbering import sliced_row_number
from newslens.session import spread, staged
from newslens.sources.feeds import mark_rejected

# Parameters of the views: words that occur in the supplied text.
GAZETTEER = {"countries": ["rewh", "inoran", "nicht"], "companies": ["license", "erenan"], "keywords": ["para", "sich"]}
RELATIONS = [("sich", "sanction"), ("para", "trade")]
WIRES = [("W1", ascii_word("pour")), ("W2", ascii_word("with")), ("W3", ascii_word("und") + "|Outlet 4")]
PRIMARY = "primary"
NOW = "2024-01-31 00:00:00"
MAX_AGE = 240


# Columns of the supplied tables that the views read; stating them saves a look into the files for every query.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def outlets(spark: SparkSession, sf: str) -> DataFrame:
    """The outlet list, written out so that joins plan with its measured size and need not move the headlines."""
    region = F.create_map(*[F.lit(x) for pair in {
        "AFRICA": "africa", "AMERICA": "latin_america", "ASIA": "east_asia", "EUROPE": "europe", "MIDDLE EAST": "middle_east",
    }.items() for x in pair])
    kinds = array_of(["estatal", "publico", "privado", "partidario", "ong", "exilio"])
    no = F.col("no")
    return staged(
        table(spark, sf, "documents").select("source").distinct()
        .withColumn("no", F.substr("source", F.lit(4)).cast("int"))
        .join(table(spark, sf, "nation"), F.col("n_nationkey") == no % 10)
        .join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
        .select(
            F.col("source").alias("source_id"), F.concat(F.lit("Outlet "), no.cast("string")).alias("name"),
            F.col("n_name").alias("country"), F.try_element_at(region, F.col("r_name")).alias("region"),
            F.when(no < 10, "oficialista").otherwise("oposicion").alias("stance"),
            F.get(kinds, (no % 10) % 6).alias("ownership"),
            F.when(no % 4 == 0, F.concat(F.lit("de "), F.lower("r_name"))).otherwise(F.lit("")).alias("ownership_note"),
            F.concat(F.lit("https://"), F.col("source"), F.lit(".example")).alias("homepage"),
            F.when(no % 14 == 6, "NO_RSS").when(no % 14 == 13, "")
            .otherwise(F.concat(F.lit("https://feeds.example/"), F.col("source"), F.lit(".xml"))).alias("rss"),
            "no",
        )
        .withColumn("has_feed", ~F.col("rss").isin("", "NO_RSS"))
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")


def headlines(spark: SparkSession, sf: str) -> DataFrame:
    """One headline per document: first line the title, the rest the snippet; `full_text` is the whole clean text.

    The narrow keys meet events and pages first; texts meet the result once, on their id.
    """
    events, pages = table(spark, sf, "events"), table(spark, sf, "pages")
    n_events, n_pages = events.agg(F.count("*")).scalar(), pages.agg(F.count("*")).scalar()
    docs = documents(spark, sf)
    keys = docs.select(
        F.col("doc_id").alias("seq"), ((F.col("doc_id") * 7919) % n_events).alias("event_id"), (F.col("doc_id") % n_pages).alias("page_id")
    )
    dated = keys.join(events.select("event_id", "ts"), "event_id").join(pages.select("page_id", "url"), "page_id").drop("event_id", "page_id")
    first = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    rest = F.substr("text", F.length(first) + 2)
    return (
        docs.select(F.col("doc_id").alias("seq"), F.col("source").alias("source_id"), "text").join(dated, "seq")
        .select(
            "seq", "source_id",
            clean_text(first, MAX_TITLE).alias("title"),
            clean_text(rest, MAX_SNIPPET).alias("snippet"),
            F.when(F.col("seq") % 17 == 0, F.lit("")).otherwise(clean_link(F.col("url"))).alias("link"),
            F.when(F.col("seq") % 11 == 0, F.lit(None)).otherwise(F.col("ts")).alias("published_at"),
            F.col("ts").cast("date").alias("edition_date"),
            collapse(F.col("text")).alias("full_text"), collapse(first).alias("whole_title"), collapse(rest).alias("whole_rest"), "text",
        )
    )


def feed_positions(h: DataFrame, feed: list[str]) -> DataFrame:
    return sliced_row_number(h, feed, [("seq", True)], "feed_pos")


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Headlines with outlet, dictionary matches over the whole text and the rule classifier's answer."""
    h = bind(headlines(spark, sf).drop("full_text"), {"full_text": collapse(F.col("text"))}).drop("text")
    h = h.join(outlets(spark, sf).drop("no"), "source_id")
    scored = tagging.rule_classify(tagging.prefilter(h, GAZETTEER, F.col("full_text")), RELATIONS)
    return scored.withColumns({
        "error": F.when(F.col("seq") % 13 == 0, F.lit("timeout")),
        "model": F.when(F.col("seq") % 5 == 0, F.lit("backup")).otherwise(F.lit(PRIMARY)),
        "reason": F.concat(F.lit("regla "), F.col("relation_type")),
    })


def audit_rows(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_entries(tagged(spark, sf), use_prefilter=True)


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted headlines with voices and story keys. Tagging reads whole texts once; what follows reads the result."""
    kept = tagged(spark, sf).where(F.col("passed") & F.col("error").isNull() & F.col("is_international"))
    voiced = stories.with_voices(
        kept.withColumnsRenamed({"matched_countries": "countries", "matched_companies": "companies"}), F.col("full_text"), WIRES
    )
    return staged(voiced.select(
        "seq", "edition_date", "source_id", "name", "country", "region", "stance", "ownership", "ownership_note", "title",
        "snippet", "link", "companies", "countries", "relation_type", "wire", "voice", "signature", "cluster_key",
    ))


def usage_stage(event_type: Column) -> Column:
    stage = {"view": "clasificacion", "click": "agrupamiento", "purchase": "redaccion", "signup": "fidelidad"}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in stage.items() for x in pair]), event_type)


def usage_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("date").alias("run"), usage_stage(F.col("event_type")).alias("stage"),
        (F.col("value").cast("decimal(18,2)") / F.lit(1000)).cast("decimal(18,6)").alias("cost"),
        F.get_json_object("props", "$.k").cast("bigint").alias("prompt_tokens"),
        (F.col("event_id") % 100).alias("completion_tokens"),
    )


def generations(spark: SparkSession, sf: str) -> DataFrame:
    """Every generation of an edition, with a stated reason for half of them."""
    return table(spark, sf, "events").where(F.col("event_type") == "error").select(
        "event_id", F.col("ts").cast("date").alias("edition_date"), F.col("ts").alias("generated_at"),
        F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("motivo "), F.col("event_id").cast("string"))).alias("reason"),
    )


def client_requests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("client"), "ts", "event_id")


def as_subscriptions(events: DataFrame) -> DataFrame:
    action = {"signup": "subscribe", "click": "confirm", "error": "unsubscribe", "view": "purge"}
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in action.items() for x in pair]), F.col("event_type"))
    return events.where(F.col("event_type") != "purchase").select(
        F.col("user_id").alias("subscriber"), "ts", "event_id", named.alias("action")
    )


def subscription_events(spark: SparkSession, sf: str) -> DataFrame:
    return as_subscriptions(table(spark, sf, "events"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Two simple models judged against the quality label."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    guess = F.array(
        F.struct(F.lit("len").alias("model"), (F.col("n_chars") >= 2000).alias("predicted")),
        F.struct(F.lit("lang").alias("model"), (F.col("lang") == "en").alias("predicted")),
    )
    return docs.join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", (F.col("quality") == 1).alias("expected"), (F.col("doc_id") % 13 == 0).alias("error"), F.explode(guess).alias("g")
    ).select("doc_id", "expected", "error", "g.model", "g.predicted")


def label_examples(spark: SparkSession, sf: str) -> DataFrame:
    good = F.col("quality") == 1
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), (good != (F.col("doc_id") % 7 == 0)).alias("expected")
    )


def judge_votes(spark: SparkSession, sf: str) -> DataFrame:
    good, d = F.col("quality") == 1, F.col("doc_id")
    votes = F.array(
        F.struct(F.lit("j1").alias("judge"), good.alias("vote")),
        F.struct(F.lit("j2").alias("judge"), (good != (d % 10 == 0)).alias("vote")),
        F.struct(F.lit("j3").alias("judge"), F.when(d % 17 != 0, good != (d % 15 == 0)).alias("vote")),
    )
    return table(spark, sf, "labels").select(d.alias("id"), F.explode(votes).alias("v")).select("id", "v.judge", "v.vote")


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """One Markdown report per document, built from all of its lines, in the edition of its headline."""
    base = headlines(spark, sf).select("seq", "edition_date", "source_id", "link", "text").join(
        outlets(spark, sf).select("source_id", "name", "country"), "source_id"
    )
    d = F.col("seq")
    labels = array_of(list(REGION_LABELS.values()))
    label = lambda i, k: F.get(labels, ((d + i + k) % 8).cast("int"))
    s = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    ds = d.cast("string")

    def piece(x: Column, i: Column) -> Column:
        a = ((d * 7 + i * 3) % 9 + 1).cast("string")
        b = ((d + i) % 40 + 1).cast("string")
        mark = F.when(d % 5 == 0, F.lit("#")).otherwise(F.lit("##"))
        k = i % 9
        return (
            F.when(k == 0, s(mark, " Resumen ejecutivo\n\n", x, " [", a, ", ", b, "]."))
            .when(k == 1, s("## Resumen por región\n\n### ", label(i, 0), "\n\n", x, " [", a, "]."))
            .when(k == 2, s("- ", x, " [", a, "][", b, "]"))
            .when(k == 3, s("- ", x))
            .when(k == 4, s("### ", label(i, 1), "\n\nSin novedades relevantes hoy.\n\n---\n### ", label(i, 2), "\n\n- ", x, " [", a, "]"))
            .when(k == 5, s("## Clima internacional\n\nver [fuente](", F.col("link"), ") y [otra](https://otro.example/", ds, "/", i.cast("string"), ") ", x))
            .when(k == 6, s("## Empresas potencialmente afectadas\n\n- ", x, " [", b, "] ![x](https://tracker.example/p.gif)"))
            .when(k == 7, s(x, " <https://otro.example/", ds, "> https://otro.example/", i.cast("string")))
            .otherwise(s("* ", x, " [9999]"))
        )

    def entry(x: Column, i: Column) -> Column:
        head = F.when(i % 4 == 0, s("\n### ", label(i, 0), "\n\n")).otherwise(F.lit(""))
        return s(head, "- [", escape_link_text(x), "](<https://", F.col("source_id"), ".example/", ds, "/", i.cast("string"),
                 ">) — ", F.col("name"), " (", F.col("country"), ")\n")

    lines = F.split("text", "\n")
    body = F.array_join(F.transform(lines, piece), "\n")
    news = F.when(d % 3 != 0, s("\n\n## Noticias utilizadas\n", F.array_join(F.transform(lines, entry), ""))).otherwise(F.lit(""))
    return base.select(F.col("seq").alias("report_id"), "edition_date", F.concat(body, news).alias("markdown"))


def stored_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Reports as a written table, for queries that read them more than once."""
    return staged(reports(spark, sf))


def _escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Feed payloads of at most 25 headlines per outlet, edition and fetch, in the outlet's format.

    By day and outlet some fail, some name an unknown charset and some are Latin-1.
    """
    h = headlines(spark, sf).select("seq", "source_id", "edition_date", "whole_title", "whole_rest", "link", "published_at")
    positioned = feed_positions(h, ["source_id", "edition_date"]).join(outlets(spark, sf).select("source_id", "no"), "source_id")
    s = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    seq, title, link, text = F.col("seq").cast("string"), _escaped(F.col("whole_title")), _escaped(F.col("link")), _escaped(F.col("whole_rest"))
    date = lambda fmt: F.coalesce(F.date_format("published_at", fmt), F.lit(""))
    dated = F.when(F.col("published_at").isNull(), "")
    item = (
        F.when(F.col("no") % 3 == 0, s(
            "<item><title>", title, "</title><link>", link, '</link><guid isPermaLink="false">id-', seq, '</guid><atom:link href="https://alt.example/',
            seq, '"/><description>', text, "</description><pubDate>",
            dated.otherwise(s(date("EEE, dd MMM yyyy HH:mm:ss"), " +0000")), "</pubDate></item>"))
        .when(F.col("no") % 3 == 1, s(
            '<entry><title type="html">', title, '</title><link href="https://self.example/', seq, '" rel="self"/><link href="', link,
            '" rel="alternate"/><summary>', text, "</summary><published>",
            dated.otherwise(s(date("yyyy-MM-dd'T'HH:mm:ss"), "Z")), "</published></entry>"))
        .otherwise(s("<item><title>", title, "</title><link>", link, "</link><description>", text, "</description><dc:date>", date("yyyy-MM-dd"), "</dc:date></item>"))
    )
    pos = F.col("feed_pos") - 1
    ordered = F.array_sort(F.collect_list(F.struct("pos", "item")))
    fetched = (
        positioned.select("source_id", "edition_date", "no", F.floor(pos / 25).alias("fetch_no"), (pos % 25).alias("pos"), item.alias("item"))
        .groupBy("source_id", "edition_date", "no", "fetch_no").agg(F.array_join(F.transform(ordered, lambda x: x["item"]), "").alias("items"))
        .withColumn("kind", (F.day("edition_date") + F.col("no")) % 7)
    )
    latin = (F.col("kind") == 5) & F.col("items").rlike(r"(?s)^[\x00-\x{FF}]*$")
    enc = F.when(F.col("kind") == 4, "koi8-r").when(latin, "iso-8859-1").otherwise("utf-8")
    wrap = lambda rss, atom, rdf: F.when(F.col("no") % 3 == 0, rss).when(F.col("no") % 3 == 1, atom).otherwise(rdf)
    xml = s(
        '<?xml version="1.0" encoding="', enc, '"?>',
        wrap('<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom"><channel><title>f</title>', '<feed xmlns="http://www.w3.org/2005/Atom">',
             '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>f</title></channel>'),
        F.col("items"), wrap("</channel></rss>", "</feed>", "</rdf:RDF>"),
    )
    text_body = F.when(F.col("kind") == 3, F.lit("<html><body>503</body></html>")).otherwise(xml)
    body = F.when(latin, F.encode(text_body, "ISO-8859-1")).otherwise(F.encode(text_body, "UTF-8"))
    return mark_rejected(fetched.select("source_id", "edition_date", "fetch_no", body.alias("body")))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Classification responses of three providers per batch: some skip items, some are fenced, some unreadable."""
    t = scoring.batch_assign(staged(tagged(spark, sf).select(
        "seq", "edition_date", "relation_type", "confidence", "is_international", "matched_countries", "matched_companies"
    )))
    ordered = F.array_sort(F.collect_list(F.struct(
        F.col("item_index").alias("index"), "seq", "is_international", F.col("matched_countries").alias("countries"),
        F.col("matched_companies").alias("companies"), "relation_type", "confidence",
    )))
    batches = t.groupBy("edition_date", "batch_no").agg(ordered.alias("items")).withColumn(
        "provider_rank", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    )
    answered = F.filter("items", lambda x: (x["seq"] + F.col("provider_rank")) % 10 != 3)
    rows = F.transform(answered, lambda x: F.to_json(F.struct(
        x["index"].alias("index"), x["is_international"].alias("is_international"), x["countries"].alias("countries"),
        x["companies"].alias("companies"), x["relation_type"].alias("relation_type"), x["confidence"].alias("confidence"),
        F.concat(F.lit("regla "), x["relation_type"]).alias("reason"),
    )))
    listed = F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]"))
    broken = (F.col("batch_no") + F.col("provider_rank") + F.day("edition_date")) % 4 == 0
    text = (
        F.when(broken, F.lit("Lo siento, no puedo."))
        .when(F.col("batch_no") % 3 == 0, F.concat(F.lit("```json\n"), listed, F.lit("\n```")))
        .when(F.col("batch_no") % 3 == 1, F.concat(F.lit("Resultado: "), listed, F.lit(" listo"))).otherwise(listed)
    )
    return batches.select("edition_date", "batch_no", "provider_rank", text.alias("response"))


def batch_items(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.batch_assign(headlines(spark, sf).select("seq", "edition_date", "title", "snippet"))
