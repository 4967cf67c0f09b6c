"""Queries over accepted notes: voices, stories, rankings, links and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from newslens.functions.wires import detect_wire, voice_key
from newslens.functions.text import normalize_set
from newslens.functions.modeljson import GROUP_SCHEMA, parse_model_json
from newslens.operators import events, reports, stories
from newslens.plans import views as v
from newslens.plans.registry import query


@query("normalize_set", r"""
SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(
  list_transform(string_split(text, ' '), lambda x: lower(replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), 'İ', 'i'))), lambda x: x <> ''))), ' '), '') AS words
FROM documents
""")
def normalize_set_query(spark, sf):
    words = normalize_set(F.split("text", " "))
    return v.table(spark, sf, "documents").select("doc_id", F.array_join(words, " ").alias("words"))


@query("detect_wire", r"""
SELECT seq, CASE WHEN regexp_matches(full_text, '\bpour\b') THEN 'W1' WHEN regexp_matches(full_text, '\bwith\b') THEN 'W2'
  WHEN regexp_matches(full_text, '\bund\b|Outlet 4') AND NOT regexp_matches(name, '\bund\b|Outlet 4') THEN 'W3' END AS wire
FROM headline JOIN outlet USING (source_id)
""", ("headline", "outlet"))
def detect_wire_query(spark, sf):
    h = v.headlines(spark, sf).join(v.outlets(spark, sf), "source_id")
    return h.select("seq", detect_wire(F.col("full_text"), F.col("name"), v.WIRES).alias("wire"))


@query("voice_key", "SELECT seq, voice FROM notes", ("notes",))
def voice_key_query(spark, sf):
    voice = voice_key(F.col("wire"), F.col("ownership"), F.col("country"), F.col("source_id"))
    return v.notes(spark, sf).select("seq", voice.alias("voice"))


@query("story_signature", "SELECT seq, signature FROM notes", ("notes",))
def story_signature(spark, sf):
    key = stories.story_signature(F.col("companies"), F.col("countries"), F.col("relation_type"))
    return v.notes(spark, sf).select("seq", key.alias("signature"))


@query("story_clusters", "SELECT * FROM clusters", ("clusters",))
def story_clusters(spark, sf):
    return stories.story_clusters(v.notes(spark, sf))


@query("wire_summary", "SELECT * FROM wire_text", ("wire_text",))
def wire_summary(spark, sf):
    return stories.wire_summary(v.notes(spark, sf))


@query("cluster_rank", "SELECT edition_date, cluster_key, weight, rank FROM ranked", ("ranked",))
def cluster_rank(spark, sf):
    return stories.cluster_rank(stories.story_clusters(v.notes(spark, sf))).select("edition_date", "cluster_key", "weight", "rank")


@query("cross_coverage", "SELECT * FROM cross_story", ("cross_story",))
def cross_coverage(spark, sf):
    return stories.cross_coverage(v.notes(spark, sf))


@query("top_cross", """
SELECT edition_date, cluster_key, weight, cross_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY edition_date ORDER BY weight DESC, first_seq) AS cross_rank FROM clusters WHERE sources > 1)
WHERE cross_rank <= 5
""", ("clusters",))
def top_cross(spark, sf):
    return stories.top_cross(v.notes(spark, sf)).select("edition_date", "cluster_key", "weight", "cross_rank")


@query("region_ranking", "SELECT edition_date, region, seq, weight, region_rank, coverage FROM region_ranked", ("region_ranked",))
def region_ranking(spark, sf):
    return stories.region_ranking(v.notes(spark, sf)).select("edition_date", "region", "seq", "weight", "region_rank", "coverage")


@query("citation_numbers", "SELECT edition_date, seq, n FROM numbered", ("numbered",))
def citation_numbers(spark, sf):
    return stories.citation_numbers(v.notes(spark, sf).select("edition_date", "seq"))


_FIRST = "SELECT * FROM notes WHERE trim(link) <> '' QUALIFY row_number() OVER (PARTITION BY edition_date, trim(link) ORDER BY seq) = 1"


@query("link_dedup", f"SELECT edition_date, seq, link FROM ({_FIRST})", ("notes",))
def link_dedup(spark, sf):
    return stories.link_dedup(v.notes(spark, sf)).select("edition_date", "seq", "link")


@query("news_links_section", rf"""
SELECT edition_date, region, country, name, seq,
  concat('- [', replace(replace(title, '[', '\['), ']', '\]'), '](<', link, '>) — ', name, ' (', country, ')') AS line FROM ({_FIRST})
""", ("notes",))
def news_links_section(spark, sf):
    listed = reports.news_list_lines(stories.news_links_section(v.notes(spark, sf)))
    return listed.select("edition_date", "region", "country", "name", "seq", "line")


def group_responses(spark, sf):
    """One grouping response per document over six items: fenced, with repeats and unknown numbers, some unreadable."""
    d = F.col("doc_id")
    s = lambda x: x.cast("string")
    body = F.concat(
        F.lit('[{"event":"hecho '), s(d), F.lit('","items":['), s(d % 7 + 1), F.lit(","), s(d % 5 + 1), F.lit(","), s(d % 3 + 1),
        F.lit(',99]},{"event":" otro ","items":['), s(d % 4 + 1), F.lit(","), s(d % 7 + 1), F.lit(",2]}]"),
    )
    text = (
        F.when(d % 9 == 0, F.lit("sin grupos")).when(d % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(d % 4 == 1, F.concat(F.lit("Grupos: "), body)).otherwise(body)
    )
    return v.table(spark, sf, "documents").select("doc_id", text.alias("response"))


_MEMBERS = """
SELECT doc_id, g, event, n, p FROM (
  SELECT doc_id, 1 AS g, concat('hecho ', doc_id) AS event, unnest([doc_id % 7 + 1, doc_id % 5 + 1, doc_id % 3 + 1, 99]) AS n, unnest([1,2,3,4]) AS p FROM documents WHERE doc_id % 9 <> 0
  UNION ALL
  SELECT doc_id, 2, 'otro', unnest([doc_id % 4 + 1, doc_id % 7 + 1, 2]), unnest([1,2,3]) FROM documents WHERE doc_id % 9 <> 0)
WHERE n BETWEEN 1 AND 6 QUALIFY row_number() OVER (PARTITION BY doc_id, n ORDER BY g, p) = 1
"""


def valid_groups(spark, sf):
    parsed = group_responses(spark, sf).withColumn("raw", parse_model_json(F.col("response"), GROUP_SCHEMA))
    groups = stories.validate_groups(F.col("raw"), F.lit(6))
    return parsed.select("doc_id", F.posexplode(groups).alias("group_no", "g")).select("doc_id", "group_no", "g.event", "g.items")


@query("validate_groups", f"""
SELECT doc_id, event, string_agg(n, ',' ORDER BY p) AS items FROM ({_MEMBERS}) GROUP BY doc_id, g, event HAVING count(*) >= 2
""")
def validate_groups(spark, sf):
    return valid_groups(spark, sf).select("doc_id", "event", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query("group_assign", f"""
SELECT seq, coalesce('group:' || g, concat('singleton:', seq)) AS cluster_key, event FROM notes LEFT JOIN (
  SELECT doc_id, min(g) AS g, min_by(event, g) AS event FROM (
    SELECT doc_id, g, event FROM ({_MEMBERS}) GROUP BY ALL HAVING count(*) >= 2) GROUP BY doc_id) ON doc_id = seq
""", ("notes",))
def group_assign(spark, sf):
    first = valid_groups(spark, sf).groupBy(F.col("doc_id").alias("seq")).agg(F.min_by(F.struct("group_no", "event"), "group_no").alias("g"))
    notes = v.notes(spark, sf)
    number = F.when(F.startswith("g.event", F.lit("hecho")), 1).otherwise(2)
    own = notes.select("edition_date", "seq").join(first, "seq").select("edition_date", "seq", "g.event", number.alias("group_no"))
    return stories.group_assign(notes, own).select("seq", "cluster_key", "event")


def titles(spark, sf):
    return v.headlines(spark, sf).select("edition_date", "seq", "title")


@query("same_event_groups", f"""
SELECT edition_date, seq, CAST(min(root) AS BIGINT) AS event_seq FROM same_event_reach GROUP BY ALL
""", ("same_event_reach",))
def same_event_groups(spark, sf):
    return events.same_event_groups(titles(spark, sf))
