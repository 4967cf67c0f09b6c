"""Queries over feed payloads and edition files."""

from __future__ import annotations

from pyspark.sql import functions as F

from newslens.functions.text import parse_pubdate
from newslens.operators import audit
from newslens.plans import daily
from newslens.plans import views as v
from newslens.plans.registry import query
from newslens.session import run_dir
from newslens.sources import editions, feeds

KEYS = ("source_id", "edition_date", "fetch_no")


def parsed(spark, sf):
    return feeds.parse_feeds(v.payloads(spark, sf), None, KEYS)


@query("feed_payloads", """
SELECT source_id, edition_date, fetch_no, CASE WHEN enc = 'iso-8859-1' THEN length(xml) ELSE strlen(xml) END AS bytes, strlen(xml) > 10485760 AS rejected FROM payload
""", ("payload",))
def feed_payloads(spark, sf):
    return v.payloads(spark, sf).select(*KEYS, F.octet_length("body").cast("bigint").alias("bytes"), "rejected")


@query("feed_charset", """
SELECT source_id, edition_date, fetch_no, CASE WHEN kind = 3 THEN '' ELSE enc END AS charset, CASE WHEN enc <> 'koi8-r' OR kind = 3 THEN xml END AS text FROM payload
""", ("payload",))
def feed_charset(spark, sf):
    body = F.col("body")
    return v.payloads(spark, sf).select(*KEYS, feeds.charset(body).alias("charset"), feeds.decode_body(body).alias("text"))


@query("feed_parse", "SELECT source_id, edition_date, fetch_no, feed_pos, title, link, snippet, published_at FROM parsed_feed", ("parsed_feed",))
def feed_parse(spark, sf):
    return parsed(spark, sf)


@query("pick_link", "SELECT source_id, edition_date, fetch_no, feed_pos, link FROM parsed_feed", ("parsed_feed",))
def pick_link(spark, sf):
    return parsed(spark, sf).select(*KEYS, "feed_pos", "link")


@query("parse_pubdate", """
SELECT event_id, layout, CASE WHEN layout IN (0, 1, 3) THEN date_trunc('second', ts) WHEN layout = 2 THEN ts WHEN layout = 4 THEN date_trunc('day', ts) END AS published_at
FROM (SELECT event_id, ts, CAST(event_id % 6 AS INTEGER) AS layout FROM events)
""")
def parse_pubdate_query(spark, sf):
    """Event times written in every layout, one of them unreadable, and parsed."""
    layout = (F.col("event_id") % 6).cast("int")
    s = lambda fmt, tail: F.concat(F.date_format("ts", fmt), F.lit(tail))
    minus3 = F.date_format(F.col("ts") - F.expr("INTERVAL 3 HOURS"), "EEE, dd MMM yyyy HH:mm:ss")
    text = (
        F.when(F.col("layout") == 0, F.concat(minus3, F.lit(" -0300"))).when(F.col("layout") == 1, s("EEE, dd MMM yyyy HH:mm:ss", " GMT"))
        .when(F.col("layout") == 2, s("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "Z")).when(F.col("layout") == 3, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("layout") == 4, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.lit("ayer"))
    )
    return v.table(spark, sf, "events").select("event_id", "ts", layout.alias("layout")).select("event_id", "layout", parse_pubdate(text).alias("published_at"))


@query("feed_failures", """
SELECT source_id, edition_date, fetch_no, CASE WHEN kind = 4 THEN 'unsupported charset' ELSE 'feed did not parse as RSS2, Atom or RDF' END AS detail
FROM payload WHERE kind IN (3, 4)
""", ("payload",))
def feed_failures(spark, sf):
    return feeds.feed_failures(v.payloads(spark, sf), parsed(spark, sf), KEYS)


_SMOKE = """
SELECT source_id, CASE WHEN NOT has_feed THEN 'skipped' WHEN sample IS NULL THEN 'failed' ELSE 'ok' END AS state, CASE WHEN has_feed THEN sample END AS sample
FROM outlet LEFT JOIN (SELECT source_id, arg_min(title, (edition_date, fetch_no, feed_pos)) AS sample FROM parsed_feed GROUP BY ALL) USING (source_id)
"""


@query("feed_smoke", _SMOKE, ("outlet", "parsed_feed"))
def feed_smoke(spark, sf):
    return feeds.feed_smoke(v.outlets(spark, sf), parsed(spark, sf))


@query("feed_smoke_totals", f"""
SELECT count(*) AS total, count(*) FILTER (state = 'ok') AS ok, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'skipped') AS skipped FROM ({_SMOKE})
""", ("outlet", "parsed_feed"))
def feed_smoke_totals(spark, sf):
    return feeds.smoke_totals(feeds.feed_smoke(v.outlets(spark, sf), parsed(spark, sf)))


@query("edition_sink", "SELECT edition_date, seq, source, title, stage FROM audit", ("audit",))
def edition_sink(spark, sf):
    """Audit rows written one partition per edition and read back."""
    rows = v.audit_rows(spark, sf).select("seq", "source", "title", "stage", "edition_date")
    path = run_dir(spark, "editions")
    editions.write_editions(rows, path, "json")
    return editions.read_editions(spark, path, "seq bigint, source string, title string, stage string, edition_date date", "json")


def edition_files(spark, sf):
    """File names of the editions, with their sidecars and files that are no edition."""
    day = F.col("ts").cast("date").cast("string")
    names = F.array(F.concat(day, F.lit(".md")), F.concat(day, F.lit(".sources.json")), F.concat(F.lit("x"), day, F.lit(".md")))
    return v.table(spark, sf, "events").select(F.explode(names).alias("file_name")).distinct()


@query("edition_scan", "SELECT DISTINCT CAST(ts AS DATE) AS edition_date FROM events")
def edition_scan(spark, sf):
    return editions.edition_dates(edition_files(spark, sf))


@query("latest_edition", "SELECT max(CAST(ts AS DATE)) AS edition_date FROM events")
def latest_edition(spark, sf):
    return editions.latest_edition(editions.edition_dates(edition_files(spark, sf)))


@query("edition_join", """
SELECT edition_date, array_to_string(sources, ', ') AS sources, coalesce(len(sources), 0) AS source_count, accepted
FROM (SELECT DISTINCT edition_date FROM headline)
LEFT JOIN (SELECT edition_date, list(DISTINCT name ORDER BY name) AS sources FROM headline JOIN outlet USING (source_id) WHERE day(edition_date) % 5 <> 0 GROUP BY ALL) USING (edition_date)
LEFT JOIN (SELECT edition_date, count(*) FILTER (stage = 'accepted') AS accepted FROM audit WHERE day(edition_date) % 4 <> 0 GROUP BY ALL) USING (edition_date)
""", ("headline", "outlet", "audit"))
def edition_join(spark, sf):
    """Editions with the outlets they heard and their accepted headlines; some lack one or the other."""
    h = v.headlines(spark, sf).select("edition_date", "source_id")
    heard = h.distinct().join(v.outlets(spark, sf).select("source_id", "name"), "source_id").groupBy("edition_date").agg(
        F.array_sort(F.collect_set("name")).alias("sources")
    ).where(F.day("edition_date") % 5 != 0)
    runs = audit.audit_counts(v.audit_rows(spark, sf)).where(F.day("edition_date") % 4 != 0).select("edition_date", "accepted")
    joined = editions.edition_join(h.select("edition_date").distinct(), heard, runs)
    return joined.select("edition_date", F.array_join("sources", ", ").alias("sources"), F.col("source_count").cast("bigint").alias("source_count"), "accepted")


_DAILY = """
SELECT edition_date, count(*) AS fetched, count(*) FILTER (NOT passed) AS prefilter_rejected, count(*) FILTER (passed AND NOT related) AS classifier_rejected,
  CAST(0 AS BIGINT) AS classifier_errors, count(*) FILTER (passed AND related) AS accepted,
  count(DISTINCT CASE WHEN has_feed THEN source_id END) AS sources_responded, (SELECT count(*) FROM outlet WHERE has_feed) AS sources_configured
FROM (SELECT *, co OR kw OR n >= 2 AS passed, kw OR co AS related FROM (
  SELECT edition_date, source_id, has_feed, contains(t, 'license') OR contains(t, 'erenan') AS co, contains(t, 'para') OR contains(t, 'sich') AS kw,
    CAST(contains(t, 'rewh') AS INTEGER) + CAST(contains(t, 'inoran') AS INTEGER) + CAST(contains(t, 'nicht') AS INTEGER) AS n
  FROM (SELECT p.*, has_feed, lower(replace(concat(title, ' ', snippet), 'İ', 'i')) AS t FROM parsed_feed p JOIN outlet USING (source_id)
        WHERE published_at IS NULL OR published_at >= TIMESTAMP '{now}' - INTERVAL {age} HOUR)))
GROUP BY edition_date
""".format(now=v.NOW, age=v.MAX_AGE)


@query("daily_edition", _DAILY, ("parsed_feed", "outlet"))
def daily_edition(spark, sf):
    """Funnel of the whole run, from payloads to accepted headlines."""
    run = daily.run_edition(
        v.payloads(spark, sf), v.outlets(spark, sf), v.GAZETTEER, v.RELATIONS, v.now(), KEYS, None, v.MAX_AGE, True, v.WIRES
    )
    return run.counts
