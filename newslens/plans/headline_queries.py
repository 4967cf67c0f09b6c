"""Queries over headlines: hygiene, tagging, stages, coverage, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from newslens.functions.text import clean_link, clean_text, collapse, escape_link_text, fingerprint, host_of, truncate
from newslens.functions.wires import source_kind
from newslens.functions.regions import region_label
from newslens.operators import audit, coverage, headlines, scoring, tagging
from newslens.plans import oracle as o
from newslens.plans import views as v
from newslens.plans.registry import query
from newslens.session import run_dir
from newslens.sources import yaml_files
from newslens.sources.outlets import with_feed_flag

_HREFS = """
SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS raw FROM pages
UNION ALL SELECT page_id, url FROM pages
"""


def page_links(spark, sf):
    """Every address on a page and the page's own."""
    pages = v.table(spark, sf, "pages")
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("raw"))
    return found.unionByName(pages.select("page_id", F.col("url").alias("raw")))


@query("outlet_dim", "SELECT source_id, name, country, region, stance, ownership, ownership_note, homepage, rss, has_feed FROM outlet", ("outlet",))
def outlet_dim(spark, sf):
    return v.outlets(spark, sf).drop("no")


def _yaml(spark, kind, documents):
    """Writes one YAML document a file (JSON is YAML too) and reads all of them back by the data source `kind`."""
    path = run_dir(spark, kind)
    documents.write.partitionBy("part").text(path)
    yaml_files.register(spark)
    return spark.read.format(kind).load(path).where("problem is null").drop("problem")


@query("outlet_yaml", "SELECT source_id, name, country, region, stance, ownership, ownership_note, homepage, rss, has_feed FROM outlet", ("outlet",))
def outlet_yaml(spark, sf):
    """The outlet list as YAML configuration, a file for each country."""
    o = v.outlets(spark, sf).drop("no", "has_feed").withColumnRenamed("source_id", "id")
    entry = F.concat(F.lit("  - "), F.to_json(F.struct(*o.columns)))
    files = o.groupBy(F.col("country").alias("part")).agg(F.concat(F.lit("sources:\n"), F.array_join(F.collect_list(entry), "\n")).alias("value"))
    return with_feed_flag(_yaml(spark, "outlets_yaml", files).drop("lang").withColumnRenamed("id", "source_id"))


@query("public_outlets", "SELECT name, country, region, stance, ownership, ownership_note, homepage, has_feed FROM outlet", ("outlet",))
def public_outlets(spark, sf):
    return coverage.public_outlets(v.outlets(spark, sf))


@query("clean_text", f"""
SELECT doc_id, {o.clean_text("split_part(text, chr(10), 1)", 300)} AS title, {o.clean_text("text", 1000)} AS snippet,
  length({o.collapse("text")}) AS whole_length FROM documents
""")
def clean_text_query(spark, sf):
    text = F.col("text")
    return v.documents(spark, sf).select(
        "doc_id", clean_text(F.split_part(text, F.lit("\n"), F.lit(1)), 300).alias("title"), clean_text(text, 1000).alias("snippet"),
        F.length(collapse(text)).cast("bigint").alias("whole_length"),
    )


@query("clean_link", f"SELECT page_id, raw, {o.clean_link('raw')} AS link FROM ({_HREFS})")
def clean_link_query(spark, sf):
    return page_links(spark, sf).withColumn("link", clean_link(F.col("raw")))


@query("domain_counts", rf"""
SELECT host, count(*) AS links FROM (
  SELECT CASE WHEN h = '' THEN raw ELSE regexp_replace(h, '^www\.', '') END AS host FROM (
    SELECT raw, lower(regexp_extract(raw, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS h FROM ({_HREFS})))
GROUP BY host
""")
def domain_counts(spark, sf):
    return page_links(spark, sf).groupBy(host_of(F.col("raw")).alias("host")).agg(F.count("*").alias("links"))


@query("prompt_fingerprint", "SELECT doc_id, sha256(text) AS sha FROM documents")
def prompt_fingerprint(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", fingerprint(F.col("text")).alias("sha"))


@query("truncate_runes", """
SELECT doc_id, CASE WHEN length(text) > 500 THEN concat(left(text, 500), '…') ELSE text END AS cut FROM documents
""")
def truncate_runes(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", truncate(F.col("text"), 500).alias("cut"))


@query("escape_link_text", f"SELECT doc_id, {o.escape_link_text('text')} AS label FROM documents")
def escape_link_text_query(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", escape_link_text(F.col("text")).alias("label"))


@query("region_label", """
SELECT source_id, region, coalesce(label, region) AS label, coalesce(rank, 9) AS rank FROM outlet LEFT JOIN region_dim USING (region)
""", ("outlet", "region_dim"))
def region_label_query(spark, sf):
    from newslens.functions.regions import region_rank

    return v.outlets(spark, sf).select("source_id", "region", region_label(F.col("region")).alias("label"), region_rank(F.col("region")).alias("rank"))


@query("source_kind", """
SELECT source_id, CASE WHEN ownership_note = '' THEN ownership ELSE concat(ownership, ' (', ownership_note, ')') END AS kind FROM outlet
""", ("outlet",))
def source_kind_query(spark, sf):
    return v.outlets(spark, sf).select("source_id", source_kind(F.col("ownership"), F.col("ownership_note")).alias("kind"))


_POSITIONED = """
SELECT seq, source_id, edition_date, published_at, CAST(row_number() OVER (PARTITION BY source_id ORDER BY seq) AS BIGINT) AS feed_pos FROM headline
"""


@query("feed_positions", _POSITIONED, ("headline",))
def feed_positions(spark, sf):
    h = v.headlines(spark, sf).select("seq", "source_id", "edition_date", "published_at")
    return v.feed_positions(h, ["source_id"])


@query("cap_per_source", f"""
SELECT seq, source_id, edition_date, feed_pos FROM ({_POSITIONED})
QUALIFY row_number() OVER (PARTITION BY source_id, edition_date ORDER BY feed_pos) <= 2
""", ("headline",))
def cap_per_source(spark, sf):
    h = v.headlines(spark, sf).select("seq", "source_id", "edition_date")
    return headlines.cap_per_source(v.feed_positions(h, ["source_id"]), 2, ("source_id", "edition_date"))


@query("drop_stale", f"""
SELECT seq, source_id, published_at FROM headline
WHERE published_at IS NULL OR published_at >= TIMESTAMP '{v.NOW}' - INTERVAL {v.MAX_AGE} HOUR
""", ("headline",))
def drop_stale(spark, sf):
    return headlines.drop_stale(v.headlines(spark, sf).select("seq", "source_id", "published_at"), v.now(), v.MAX_AGE)


@query("stale_by_source", f"""
SELECT name, count(*) AS dropped FROM headline JOIN outlet USING (source_id)
WHERE published_at < TIMESTAMP '{v.NOW}' - INTERVAL {v.MAX_AGE} HOUR GROUP BY name
""", ("headline", "outlet"))
def stale_by_source(spark, sf):
    return headlines.stale_by_source(v.headlines(spark, sf), v.outlets(spark, sf), v.now(), v.MAX_AGE)


@query("headline_outlet", "SELECT seq, title, link, name, country, region FROM headline JOIN outlet USING (source_id)", ("headline", "outlet"))
def headline_outlet(spark, sf):
    return headlines.headline_outlet(v.headlines(spark, sf), v.outlets(spark, sf)).select("seq", "title", "link", "name", "country", "region")


@query("prefilter", """
SELECT seq, array_to_string(m_countries, ',') AS countries, array_to_string(m_companies, ',') AS companies,
  array_to_string(m_keywords, ',') AS keywords, passed FROM tagged
""", ("tagged",))
def prefilter(spark, sf):
    t = tagging.prefilter(v.headlines(spark, sf), v.GAZETTEER, F.col("full_text"))
    return t.select("seq", *[F.array_join(f"matched_{k}", ",").alias(k) for k in ("countries", "companies", "keywords")], "passed")


@query("prefilter_switch", "SELECT 'on' AS mode, seq FROM tagged WHERE passed UNION ALL SELECT 'off', seq FROM headline", ("tagged",))
def prefilter_switch(spark, sf):
    h = tagging.prefilter(v.headlines(spark, sf), v.GAZETTEER, F.col("full_text"))
    rows = lambda mode, on: tagging.prefilter_switch(h, on).select(F.lit(mode).alias("mode"), "seq")
    return rows("on", True).unionByName(rows("off", False))


@query("rule_classify", """
SELECT seq, relation_type, confidence, passed AND relation_type <> 'none' AS is_international FROM tagged
""", ("tagged",))
def rule_classify(spark, sf):
    t = tagging.prefilter(v.headlines(spark, sf), v.GAZETTEER, F.col("full_text"))
    return tagging.rule_classify(t, v.RELATIONS).select("seq", "relation_type", "confidence", "is_international")


@query("accepted", "SELECT seq, relation_type FROM tagged WHERE passed AND relation_type <> 'none'", ("tagged",))
def accepted(spark, sf):
    t = tagging.rule_classify(tagging.prefilter(v.headlines(spark, sf), v.GAZETTEER, F.col("full_text")), v.RELATIONS)
    return tagging.accepted(t).select("seq", "relation_type")


_TERMS = """
SELECT CASE length(term) % 3 WHEN 0 THEN 'countries' WHEN 1 THEN 'companies' ELSE 'keywords' END AS kind, term
FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{7,}')) AS term FROM benchmark)
"""


def benchmark_terms(spark, sf):
    """Long words of the benchmark passages as a dictionary."""
    from newslens.sources.gazetteer import gazetteer_terms

    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0))
    with_rest = lambda i: F.filter(words, lambda t: F.length(t) % 3 == i)
    lists = v.table(spark, sf, "benchmark").select(
        with_rest(0).alias("countries"), with_rest(1).alias("companies"), with_rest(2).alias("keywords")
    )
    return gazetteer_terms(lists).distinct()


@query("gazetteer_dim", _TERMS)
def gazetteer_dim(spark, sf):
    return benchmark_terms(spark, sf)


@query("gazetteer_yaml", _TERMS)
def gazetteer_yaml(spark, sf):
    """The dictionary as YAML configuration in several files."""
    lists = [F.collect_list(F.when(F.col("kind") == k, F.col("term"))).alias(k) for k in ("countries", "companies", "keywords")]
    files = benchmark_terms(spark, sf).groupBy(F.pmod(F.hash("term"), F.lit(4)).alias("part")).agg(*lists)
    return _yaml(spark, "gazetteer_yaml", files.select("part", F.to_json(F.struct("countries", "companies", "keywords")).alias("value")))


@query("gazetteer_join", f"""
SELECT doc_id, kind, term FROM (SELECT doc_id, lower(replace(text, 'İ', 'i')) AS lc FROM documents)
JOIN (SELECT kind, term, lower(term) AS needle FROM ({_TERMS})) ON contains(lc, needle)
""")
def gazetteer_join(spark, sf):
    docs = v.documents(spark, sf).select("doc_id", "text")
    return tagging.gazetteer_join(docs, benchmark_terms(spark, sf), "doc_id", F.col("text"))


_LARGE = """
SELECT 'keywords' AS kind, term FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{7,}')) AS term FROM conversations)
"""


@query("gazetteer_join_large", f"""
SELECT doc_id, kind, term FROM (SELECT doc_id, lower(replace(text, 'İ', 'i')) AS lc FROM documents)
JOIN (SELECT kind, term, lower(term) AS needle FROM ({_LARGE})) ON contains(lc, needle)
""")
def gazetteer_join_large(spark, sf):
    """The dictionary join in several shards, with the long words of all conversations as the dictionary."""
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0)))
    terms = v.table(spark, sf, "conversations").select(F.lit("keywords").alias("kind"), words.alias("term")).distinct()
    return tagging.gazetteer_join(v.documents(spark, sf).select("doc_id", "text"), terms, "doc_id", F.col("text"), shard_bytes=1 << 16)


_CURRENT = f"(published_at IS NULL OR published_at >= TIMESTAMP '{v.NOW}' - INTERVAL 30 HOUR)"


def recent(spark, sf):
    """Headlines of the last 30 hours and those without a date."""
    return headlines.drop_stale(v.headlines(spark, sf), v.now(), 30)


@query("region_coverage", f"""
SELECT region, count(*) AS configured, count(r.source_id) AS responded, count(*) > 0 AND count(r.source_id) * 2 < count(*) AS low
FROM outlet o LEFT JOIN (SELECT DISTINCT source_id FROM headline WHERE {_CURRENT}) r USING (source_id)
WHERE has_feed GROUP BY region
""", ("outlet", "headline"))
def region_coverage(spark, sf):
    return coverage.region_coverage(v.outlets(spark, sf), recent(spark, sf))


@query("empty_region_text", "SELECT edition_date, region, configured, responded, low, empty_text FROM edition_cov", ("edition_cov",))
def empty_region_text(spark, sf):
    return coverage.edition_coverage(v.outlets(spark, sf), v.headlines(spark, sf))


_STATUS = f"""
SELECT source_id, name, country, region, CASE WHEN detail <> '' THEN 'error' WHEN headlines = 0 THEN 'sin_vigentes' ELSE 'ok' END AS status,
  detail, headlines FROM (
  SELECT o.source_id, name, country, region, coalesce(detail, '') AS detail, coalesce(n, 0) AS headlines FROM outlet o
  LEFT JOIN (SELECT source_id, count(*) AS n FROM headline WHERE {_CURRENT} GROUP BY ALL) USING (source_id)
  LEFT JOIN (SELECT source_id, concat('fetch failed ', count(*)) AS detail FROM headline WHERE source_id IN ('src3', 'src12') GROUP BY ALL) USING (source_id)
  WHERE has_feed)
"""


def statuses(spark, sf):
    h = v.headlines(spark, sf)
    errors = h.where(F.col("source_id").isin("src3", "src12")).groupBy("source_id").agg(
        F.concat(F.lit("fetch failed "), F.count("*").cast("string")).alias("detail")
    )
    return coverage.source_status(v.outlets(spark, sf), recent(spark, sf), errors)


@query("source_status", _STATUS, ("outlet", "headline"))
def source_status(spark, sf):
    return statuses(spark, sf)


@query("source_status_join", _STATUS, ("outlet", "headline"))
def source_status_join(spark, sf):
    return statuses(spark, sf)


@query("source_problems", f"SELECT * FROM ({_STATUS}) WHERE status <> 'ok'", ("outlet", "headline"))
def source_problems(spark, sf):
    return coverage.source_problems(statuses(spark, sf))


@query("distinct_outlets", "SELECT DISTINCT country, name FROM outlet JOIN headline USING (source_id)", ("outlet", "headline"))
def distinct_outlets(spark, sf):
    return coverage.distinct_outlets(v.outlets(spark, sf), v.headlines(spark, sf))


@query("outlets_by_country", "SELECT country, string_agg(name, ', ' ORDER BY name) AS names FROM outlet GROUP BY country", ("outlet",))
def outlets_by_country(spark, sf):
    return coverage.outlets_by_country(v.outlets(spark, sf)).withColumn("names", F.array_join("names", ", "))


@query("balance_matrix", """
SELECT region, label, rank, count(*) FILTER (stance = 'oficialista') AS oficialista, count(*) FILTER (stance = 'oposicion') AS oposicion,
  count(*) AS total, string_agg(DISTINCT country, ', ' ORDER BY country) AS countries,
  (SELECT count(*) FROM outlet WHERE NOT has_feed) AS inactive
FROM outlet JOIN region_dim USING (region) WHERE has_feed GROUP BY region, label, rank
""", ("outlet", "region_dim"))
def balance_matrix(spark, sf):
    return coverage.balance_matrix(v.outlets(spark, sf)).withColumn("countries", F.array_join("countries", ", "))


@query("audit_union", "SELECT * FROM audit", ("audit",))
def audit_union(spark, sf):
    return v.audit_rows(spark, sf)


@query("audit_sorted", "SELECT edition_date, source, title, seq, stage FROM audit", ("audit",))
def audit_sorted(spark, sf):
    return audit.audit_sorted(v.audit_rows(spark, sf)).select("edition_date", "source", "title", "seq", "stage")


@query("audit_counts", """
SELECT edition_date, count(*) AS fetched, count(*) FILTER (stage = 'prefilter_rejected') AS prefilter_rejected,
  count(*) FILTER (stage = 'classifier_rejected') AS classifier_rejected, count(*) FILTER (stage = 'classifier_error') AS classifier_errors,
  count(*) FILTER (stage = 'accepted') AS accepted, (SELECT count(*) FROM outlet WHERE has_feed) AS sources_configured,
  count(DISTINCT CASE WHEN has_feed THEN source_id END) AS sources_responded
FROM audit JOIN (SELECT seq, source_id, has_feed FROM tagged) USING (seq) GROUP BY edition_date
""", ("audit", "tagged", "outlet"))
def audit_counts(spark, sf):
    h = v.headlines(spark, sf).select("edition_date", "source_id")
    return audit.with_source_counts(audit.audit_counts(v.audit_rows(spark, sf)), h, v.outlets(spark, sf))


@query("models_used", "SELECT edition_date, model, count(*) AS notes FROM audit WHERE model IS NOT NULL GROUP BY ALL", ("audit",))
def models_used(spark, sf):
    return audit.models_used(v.audit_rows(spark, sf))


@query("fallback_used", "SELECT edition_date, coalesce(bool_or(model <> 'primary'), false) AS fallback_used FROM audit GROUP BY ALL", ("audit",))
def fallback_used(spark, sf):
    return audit.fallback_used(v.audit_rows(spark, sf), v.PRIMARY)


@query("month_archive", """
SELECT strftime(edition_date, '%Y-%m') AS month, string_agg(CAST(edition_date AS VARCHAR), ',' ORDER BY edition_date DESC) AS dates
FROM (SELECT DISTINCT edition_date FROM headline) GROUP BY 1
""", ("headline",))
def month_archive(spark, sf):
    return audit.month_archive(v.headlines(spark, sf)).withColumn("dates", F.array_join("dates", ","))


@query("feed_window", "SELECT seq, edition_date FROM headline WHERE edition_date >= (SELECT max(edition_date) FROM headline) - 6", ("headline",))
def feed_window(spark, sf):
    return audit.feed_window(v.headlines(spark, sf).select("seq", "edition_date"))


@query("batch_assign", """
SELECT seq, edition_date, CAST((rn - 1) // 16 AS BIGINT) AS batch_no, CAST((rn - 1) % 16 AS INTEGER) AS item_index
FROM (SELECT seq, edition_date, row_number() OVER (PARTITION BY edition_date ORDER BY seq) AS rn FROM headline)
""", ("headline",))
def batch_assign(spark, sf):
    return scoring.batch_assign(v.headlines(spark, sf).select("seq", "edition_date"))
