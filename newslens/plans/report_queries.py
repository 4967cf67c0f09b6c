"""Queries over published reports: sections, links, citations, claims, regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from newslens.functions import markdown as md
from newslens.functions.modeljson import VERDICT_SCHEMA, parse_model_json
from newslens.operators import coverage, reports
from newslens.plans import oracle as o
from newslens.plans import views as v
from newslens.plans.registry import query
from newslens.session import staged

_NL = "chr(10)"


@query("edition_md", "SELECT report_id, edition_date, markdown FROM report", ("report",))
def edition_md(spark, sf):
    return v.reports(spark, sf)


@query("markdown_sections", "SELECT report_id, edition_date, CAST(section_no AS INTEGER) AS section_no, heading, body FROM section", ("section",))
def markdown_sections(spark, sf):
    return reports.section_rows(v.reports(spark, sf))


@query("markdown_sections_last", """
SELECT report_id, edition_date, heading, body FROM section QUALIFY section_no = max(section_no) OVER (PARTITION BY report_id, heading)
""", ("section",))
def markdown_sections_last(spark, sf):
    return reports.section_rows(v.reports(spark, sf), keep="last").drop("section_no")


_SUBS = rf"""
SELECT report_id, edition_date, CAST(section_no AS INTEGER) AS section_no, section, CAST(k - 1 AS INTEGER) AS sub_no,
  {o.strip("split_part(p, chr(10), 1)")} AS heading, {o.strip("substr(p, length(split_part(p, chr(10), 1)) + 1)")} AS body
FROM (SELECT report_id, edition_date, section_no, heading AS section, unnest(string_split({_NL} || body, {_NL} || '### ')) AS p,
        generate_subscripts(string_split({_NL} || body, {_NL} || '### '), 1) AS k FROM section) WHERE k > 1
"""


@query("markdown_subsections", _SUBS, ("section",))
def markdown_subsections(spark, sf):
    return reports.subsection_rows(v.reports(spark, sf))


@query("split_regions", f"""
SELECT report_id, edition_date, sub_no, heading AS region, body, body = 'Sin novedades relevantes hoy.' AS empty,
  starts_with(body, 'Cobertura insuficiente') AS insufficient
FROM ({_SUBS}) WHERE section = 'Resumen por región'
QUALIFY section_no = max(section_no) OVER (PARTITION BY report_id)
""", ("section",))
def split_regions(spark, sf):
    return reports.split_regions(v.reports(spark, sf))


@query("split_abstract", rf"""
SELECT report_id, CASE WHEN found THEN abstract END AS abstract,
  CASE WHEN found THEN CASE WHEN at_pos = 0 THEN '' ELSE substr(after, at_pos + 1) END ELSE markdown END AS body
FROM (SELECT *, starts_with(start, '## Resumen ejecutivo') AND abstract <> '' AS found FROM (
  SELECT *, {o.strip("CASE WHEN at_pos = 0 THEN after ELSE left(after, at_pos - 1) END")} AS abstract FROM (
    SELECT *, strpos(after, {_NL} || '## ') AS at_pos FROM (
      SELECT *, substr(start, 21) AS after FROM (
        SELECT report_id, markdown, regexp_replace(markdown, '^\s+', '') AS start FROM report)))))
""", ("report",))
def split_abstract(spark, sf):
    parts = md.split_abstract(F.col("markdown"))
    return v.reports(spark, sf).select("report_id", parts.alias("p")).select("report_id", "p.abstract", "p.body")


_NEWS = rf"""
SELECT report_id, edition_date, CAST(g - 2 AS INTEGER) AS group_no, CAST(l - 1 AS INTEGER) AS line_no, region,
  regexp_replace(regexp_extract(line, '^- \[(.+)\]\(<(.+?)>\) — (.+) \(([^()]+)\)$', 1), '\\([\[\]])', '\1', 'g') AS title,
  regexp_extract(line, '^- \[(.+)\]\(<(.+?)>\) — (.+) \(([^()]+)\)$', 2) AS url,
  regexp_extract(line, '^- \[(.+)\]\(<(.+?)>\) — (.+) \(([^()]+)\)$', 3) AS outlet,
  regexp_extract(line, '^- \[(.+)\]\(<(.+?)>\) — (.+) \(([^()]+)\)$', 4) AS country
FROM (SELECT report_id, edition_date, g, {o.strip("split_part(p, chr(10), 1)")} AS region, {o.strip("unnest(string_split(p, chr(10)))")} AS line,
        generate_subscripts(string_split(p, chr(10)), 1) AS l
      FROM (SELECT report_id, edition_date, unnest(string_split_regex(block, '\n[ \t\r\f]*### ')) AS p,
              generate_subscripts(string_split_regex(block, '\n[ \t\r\f]*### '), 1) AS g
            FROM (SELECT report_id, edition_date, substr(markdown, strpos(markdown, {_NL} || '## Noticias utilizadas') + 1) AS block FROM report
                  WHERE strpos(markdown, {_NL} || '## Noticias utilizadas') > 0)) WHERE g > 1)
WHERE l > 1 AND regexp_matches(line, '^- \[(.+)\]\(<(.+?)>\) — (.+) \(([^()]+)\)$')
"""


@query("news_links_parse", _NEWS, ("report",))
def news_links_parse(spark, sf):
    return reports.news_links(v.reports(spark, sf))


@query("news_link_counts", f"""
SELECT edition_date, region, count(*) AS links FROM ({_NEWS}) GROUP BY GROUPING SETS ((edition_date, region), (edition_date))
""", ("report",))
def news_link_counts(spark, sf):
    links = reports.news_links(v.reports(spark, sf))
    return links.groupingSets([["edition_date", "region"], ["edition_date"]], "edition_date", "region").agg(F.count("*").alias("links"))


@query("normalize_headings", rf"""
SELECT report_id, array_to_string(list_transform(list_filter(string_split(markdown, {_NL}), lambda x: {o.strip("x")} <> '---'),
  lambda x: CASE WHEN starts_with({o.strip("x")}, '# ') AND len(list_filter(['## Resumen ejecutivo', '## Resumen por región', '## Clima internacional',
    '## Empresas potencialmente afectadas'], lambda h: starts_with(concat('#', {o.strip("x")}), h))) > 0 THEN concat('#', {o.strip("x")}) ELSE x END), {_NL}) AS markdown
FROM report
""", ("report",))
def normalize_headings(spark, sf):
    return v.reports(spark, sf).select("report_id", md.normalize_headings(F.col("markdown")).alias("markdown"))


@query("report_complete", """
SELECT report_id, contains(markdown, '## Resumen ejecutivo') AND contains(markdown, '## Resumen por región')
  AND contains(markdown, '## Clima internacional') AND contains(markdown, '## Empresas potencialmente afectadas') AS complete FROM report
""", ("report",))
def report_complete(spark, sf):
    return v.reports(spark, sf).select("report_id", md.report_complete(F.col("markdown")).alias("complete"))


@query("reading_minutes", r"""
SELECT report_id, edition_date, CAST(greatest(1, round(len(regexp_extract_all(t, '[^\s\p{Z}]*[\p{L}\p{N}][^\s\p{Z}]*')) / 200.0::DOUBLE)) AS INTEGER) AS minutes FROM (
  SELECT report_id, edition_date, regexp_replace(regexp_replace(regexp_replace(split_part(markdown, chr(10) || '## Noticias utilizadas', 1),
    '\[\[\d+\]\]\(<[^>]*>\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[#*_>`|-]', ' ', 'g') AS t FROM report)
""", ("report",))
def reading_minutes(spark, sf):
    return reports.reading_time(v.reports(spark, sf))


@query("allowed_link_semi", """
SELECT DISTINCT report_id, edition_date, url FROM link_token JOIN note_link USING (edition_date, url) WHERE url IS NOT NULL
""", ("link_token", "note_link"))
def allowed_link_semi(spark, sf):
    return reports.known_links(v.reports(spark, sf), v.notes(spark, sf))


@query("unknown_link_anti", """
SELECT DISTINCT report_id, edition_date, url FROM link_token ANTI JOIN note_link USING (edition_date, url) WHERE url IS NOT NULL
""", ("link_token", "note_link"))
def unknown_link_anti(spark, sf):
    return reports.known_links(v.reports(spark, sf), v.notes(spark, sf), "left_anti")


@query("strip_unknown_links", r"""
SELECT report_id, edition_date, string_agg(CASE WHEN t.url IS NULL OR keep THEN tok WHEN md AND NOT starts_with(tok, '!')
    THEN regexp_extract(tok, '!?\[([^\]]*)\]\(([^)\s]*)(?:\s+"[^"]*")?\)', 1) ELSE '' END, '' ORDER BY pos) AS markdown,
  CAST(count(*) FILTER (t.url IS NOT NULL AND NOT keep) AS INTEGER) AS removed
FROM (SELECT t.*, n.url IS NOT NULL AND NOT starts_with(tok, '!') AS keep FROM link_token t LEFT JOIN note_link n USING (edition_date, url)) t
GROUP BY report_id, edition_date
""", ("link_token", "note_link"))
def strip_unknown_links(spark, sf):
    return reports.strip_unknown_links(v.stored_reports(spark, sf), v.notes(spark, sf))


@query("citation_lookup", """
SELECT DISTINCT c.report_id, c.edition_date, c.n, m.link FROM cite_number c LEFT JOIN numbered m ON m.edition_date = c.edition_date AND m.n = c.n
""", ("cite_number", "numbered"))
def citation_lookup(spark, sf):
    return reports.citation_lookup(v.reports(spark, sf), v.notes(spark, sf))


_UNCITED = """
SELECT report_id, count(*) AS uncited FROM body_line
WHERE NOT (starts_with(t, 'Sin novedades') OR starts_with(t, 'Cobertura insuficiente') OR starts_with(t, '_Cobertura parcial'))
  AND (starts_with(t, '- ') OR starts_with(t, '* ') OR section IN ('Resumen ejecutivo', 'Resumen por región')) AND NOT contains(t, '[[')
GROUP BY report_id
"""
_STATS = f"""
SELECT report_id, edition_date, markdown, CAST(resolved AS INTEGER) AS resolved, CAST(invalid AS INTEGER) AS invalid,
  CAST(coalesce(uncited, 0) AS INTEGER) AS uncited FROM resolved_report LEFT JOIN ({_UNCITED}) USING (report_id)
"""


def resolved(spark, sf):
    return reports.resolve_citations(v.stored_reports(spark, sf), v.notes(spark, sf))


@query("resolve_citations", _STATS, ("resolved_report", "body_line"))
def resolve_citations(spark, sf):
    return resolved(spark, sf)


@query("count_uncited", f"SELECT report_id, uncited FROM ({_STATS})", ("resolved_report", "body_line"))
def count_uncited(spark, sf):
    return resolved(spark, sf).select("report_id", "uncited")


@query("citation_stats", f"""
SELECT edition_date, CAST(sum(resolved) AS BIGINT) AS resolved, CAST(sum(invalid) AS BIGINT) AS invalid, CAST(sum(uncited) AS BIGINT) AS uncited
FROM ({_STATS}) GROUP BY edition_date
""", ("resolved_report", "body_line"))
def citation_stats(spark, sf):
    return reports.citation_stats(resolved(spark, sf))


@query("extract_claims", """
SELECT report_id, edition_date, claim_no, section, text, nums, array_to_string(links, ' ') AS links FROM claim
JOIN (SELECT report_id, claim_no, string_agg(n, ',' ORDER BY k) AS nums FROM claim_num GROUP BY ALL) USING (report_id, claim_no)
""", ("claim", "claim_num"))
def extract_claims(spark, sf):
    rows = reports.claims(resolved(spark, sf))
    return rows.withColumn("nums", F.array_join(F.col("nums").cast("array<string>"), ",")).withColumn("links", F.array_join("links", " "))


def batched(spark, sf):
    return reports.claim_batches(reports.claims(resolved(spark, sf)))


@query("evidence_bundle", """
SELECT report_id, edition_date, CAST(claim_no // 30 AS INTEGER) AS batch_no, string_agg(line, '' ORDER BY claim_no, k) AS evidence FROM (
  SELECT report_id, edition_date, claim_no, -1 AS k, concat('AFIRMACIÓN ', claim_no % 30 + 1, ' (sección ', section, '):', chr(10), text, chr(10)) AS line FROM claim
  UNION ALL SELECT report_id, edition_date, claim_no, 1000000, chr(10) FROM claim
  UNION ALL SELECT c.report_id, c.edition_date, claim_no, k, concat('  Nota [', c.n, '] — ', name, ' (', country, ', medio ',
      CASE WHEN ownership_note = '' THEN ownership ELSE concat(ownership, ' (', ownership_note, ')') END, '): ', title, ' — ',
      CASE WHEN length(snippet) > 500 THEN concat(left(snippet, 500), '…') ELSE snippet END, chr(10))
    FROM claim_num c JOIN numbered m ON m.edition_date = c.edition_date AND m.n = c.n)
GROUP BY ALL
""", ("claim", "claim_num", "numbered"))
def evidence_bundle(spark, sf):
    return reports.evidence_bundle(batched(spark, sf), v.notes(spark, sf))


def verdicts(claims):
    """Verification responses for batches of claims, some skipping claims and some unreadable, parsed."""
    k = (F.col("report_id") + F.col("id")) % 4
    words = F.array(*[F.lit(x) for x in ("respaldada", "inferencia", "sin_respaldo", "dudosa")])
    item = F.to_json(F.struct("id", F.get(words, k.cast("int")).alias("verdict"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("problem")))
    kept = F.when((F.col("report_id") + F.col("id")) % 7 != 0, item)
    listed = F.concat(F.lit("```json\n["), F.array_join(F.collect_list(kept), ","), F.lit("]\n```"))
    text = F.when(F.col("report_id") % 9 == 0, F.lit("no puedo verificar")).otherwise(F.col("response"))
    responses = claims.groupBy("report_id", "batch_no").agg(listed.alias("response")).withColumn("response", text)
    parsed = responses.select("report_id", "batch_no", F.posexplode(parse_model_json(F.col("response"), VERDICT_SCHEMA)).alias("pos", "v"))
    return parsed.select("report_id", "batch_no", "pos", "v.*")


_JUDGED = """
SELECT report_id, edition_date, claim_no, CASE WHEN report_id % 9 <> 0 AND (report_id + claim_no % 30 + 1) % 7 <> 0 THEN
  ['respaldada', 'inferencia', 'sin_respaldo', 'dudosa'][(report_id + claim_no % 30 + 1) % 4 + 1] END AS verdict FROM claim
"""


def judged(spark, sf):
    claims = staged(batched(spark, sf))
    return reports.verdict_join(claims, verdicts(claims))


@query("verdict_join", _JUDGED, ("claim",))
def verdict_join(spark, sf):
    return judged(spark, sf).select("report_id", "edition_date", "claim_no", "verdict")


@query("fidelity_counts", f"""
SELECT edition_date, count(verdict) AS checked, count(*) FILTER (verdict = 'respaldada') AS supported,
  count(*) FILTER (verdict = 'inferencia') AS inference, count(*) FILTER (verdict NOT IN ('respaldada', 'inferencia')) AS unsupported
FROM ({_JUDGED}) GROUP BY edition_date
""", ("claim",))
def fidelity_counts(spark, sf):
    return reports.fidelity_counts(judged(spark, sf))


_SPAN = f"""
SELECT *, CASE WHEN nxt = 0 THEN length(markdown) + 1 ELSE start + 21 + nxt - 1 END AS fin FROM (
  SELECT *, strpos(substr(markdown, start + 21), {_NL} || '## ') AS nxt FROM (
    SELECT report_id, edition_date, markdown, strpos(markdown, '## Resumen por región') AS start FROM report))
"""
_MISSING = rf"""
SELECT s.report_id, s.edition_date, d.region, d.label, d.rank FROM ({_SPAN}) s, region_dim d
WHERE s.start = 0 OR NOT list_contains(list_transform(string_split(substr(markdown, start, fin - start), {_NL} || '### ')[2:],
  lambda p: {o.strip("split_part(p, chr(10), 1)")}), d.label)
"""


@query("missing_regions", f"SELECT report_id, edition_date, region FROM ({_MISSING})", ("report", "region_dim"))
def missing_regions(spark, sf):
    return reports.missing_regions(v.reports(spark, sf))


@query("fill_missing_regions", f"""
SELECT report_id, edition_date, CASE WHEN start = 0 THEN markdown ELSE concat(left(markdown, fin - 1), coalesce(repair, ''), substr(markdown, fin)) END AS markdown
FROM ({_SPAN}) LEFT JOIN (
  SELECT report_id, string_agg(concat({_NL}, '### ', m.label, {_NL}, {_NL}, empty_text, {_NL}), '' ORDER BY m.rank) AS repair
  FROM ({_MISSING}) m JOIN edition_cov c ON c.edition_date = m.edition_date AND c.region = m.region GROUP BY report_id) USING (report_id)
""", ("report", "region_dim", "edition_cov"))
def fill_missing_regions(spark, sf):
    cover = coverage.edition_coverage(v.outlets(spark, sf), v.headlines(spark, sf))
    return reports.fill_missing_regions(v.reports(spark, sf), cover)


@query("digest_input", """
SELECT edition_date, 0 AS block, rank AS position, CAST(0 AS BIGINT) AS line_no, concat('- ', title, ' — ', sources, ' medios en ', countries, ' país(es) (',
  media_countries, '); fuentes independientes: ', voices, ', de ', voice_countries, ' país(es)', CASE WHEN wires <> '' THEN concat(' (cables: ', wires, ')') ELSE '' END) AS text
FROM cross_story
UNION ALL SELECT x.edition_date, 1, rank, n, concat('[', n, ']') FROM cross_story x JOIN digest_number USING (edition_date, cluster_key)
UNION ALL SELECT edition_date, 2, rank, -1, concat('REGIÓN: ', label, ' (respondieron hoy ', responded, ' de ', configured, ' medios)') FROM edition_cov
UNION ALL SELECT edition_date, 2, rank, 0, CASE WHEN r.region IS NULL THEN empty_text ELSE concat('_Cobertura parcial: respondieron ', responded, ' de ', configured, ' medios de la región._') END
  FROM edition_cov LEFT JOIN (SELECT DISTINCT edition_date, region FROM notes) r USING (edition_date, region) WHERE r.region IS NULL OR low
UNION ALL SELECT r.edition_date, 2, d.rank, region_rank, concat('- [', n, '] [', r.country, ' | ', r.name, ' | ', r.stance, ' | tipo: ',
    CASE WHEN r.ownership_note = '' THEN r.ownership ELSE concat(r.ownership, ' (', r.ownership_note, ')') END, '] ', r.title, ' (países: [', array_to_string(r.countries, ' '),
    '], empresas: [', array_to_string(r.companies, ' '), '], relación: ', r.relation_type, ')', coverage)
  FROM region_ranked r JOIN (SELECT seq, n FROM digest_number) USING (seq) JOIN region_dim d ON d.region = r.region
""", ("cross_story", "digest_number", "edition_cov", "region_ranked", "region_dim"))
def digest_input(spark, sf):
    return reports.digest_input(v.notes(spark, sf), v.outlets(spark, sf), v.headlines(spark, sf))
