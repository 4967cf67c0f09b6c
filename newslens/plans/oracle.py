"""The views of `views.py` in SQL, and helpers that put a query together from the views it needs."""

from __future__ import annotations

# One entry per view: its text and the views it reads.
_VIEWS: dict[str, tuple[str, list[str]]] = {}


def _view(name: str, text: str, needs: list[str] | None = None) -> None:
    _VIEWS[name] = (text.strip(), needs or [])


def with_views(query: str, *names: str) -> str:
    """`query` preceded by the named views and everything they read, each once and in order."""
    done: list[str] = []

    def add(n: str) -> None:
        for m in _VIEWS[n][1]:
            add(m)
        if n not in done:
            done.append(n)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_VIEWS[n][0]})" for n in done) + "\n" + query.strip()


BLANK = r"'[\p{Z}\p{Cc}]+'"


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, {BLANK}, ' ', 'g'))"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def clean_text(c: str, n: int) -> str:
    t = collapse(c)
    return f"CASE WHEN length({t}) > {n} THEN concat(rtrim(left({t}, {n - 1})), '…') ELSE {t} END"


def clean_link(c: str) -> str:
    t = strip(c)
    return (
        rf"CASE WHEN regexp_matches({t}, '^(?i:https?)://[^/?#\s\p{{Cc}}]+[^\p{{Cc}}]*$') THEN "
        rf"concat(lower(regexp_extract({t}, '^([A-Za-z]+)://', 1)), "
        rf"replace(regexp_extract({t}, '(?s)^[A-Za-z]+(://.*)$', 1), ' ', '%20')) ELSE '' END"
    )


def escape_link_text(c: str) -> str:
    one = strip(rf"regexp_replace({c}, '\s+', ' ', 'g')")
    return rf"replace(replace({one}, '[', '\['), ']', '\]')"


def terms(column: str, words: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"list_filter([{listed}], lambda t: contains({column}, t))"


_view("outlet", """
SELECT source AS source_id, concat('Outlet ', no) AS name, n_name AS country,
  CASE r_name WHEN 'AFRICA' THEN 'africa' WHEN 'AMERICA' THEN 'latin_america' WHEN 'ASIA' THEN 'east_asia'
       WHEN 'EUROPE' THEN 'europe' WHEN 'MIDDLE EAST' THEN 'middle_east' END AS region,
  CASE WHEN no < 10 THEN 'oficialista' ELSE 'oposicion' END AS stance,
  ['estatal','publico','privado','partidario','ong','exilio'][(no % 10) % 6 + 1] AS ownership,
  CASE WHEN no % 4 = 0 THEN concat('de ', lower(r_name)) ELSE '' END AS ownership_note,
  concat('https://', source, '.example') AS homepage,
  CASE WHEN no % 14 = 6 THEN 'NO_RSS' WHEN no % 14 = 13 THEN '' ELSE concat('https://feeds.example/', source, '.xml') END AS rss,
  no % 14 NOT IN (6, 13) AS has_feed, no
FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INTEGER) AS no FROM documents)
JOIN nation ON n_nationkey = no % 10 JOIN region ON r_regionkey = n_regionkey
""")

_view("headline", f"""
SELECT doc_id AS seq, source AS source_id, {clean_text("l1", 300)} AS title, {clean_text("rest", 1000)} AS snippet,
  CASE WHEN doc_id % 17 = 0 THEN '' ELSE {clean_link("url")} END AS link,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE ts END AS published_at, CAST(ts AS DATE) AS edition_date,
  {collapse("text")} AS full_text, {collapse("l1")} AS whole_title, {collapse("rest")} AS whole_rest, text
FROM (SELECT *, split_part(text, chr(10), 1) AS l1, substr(text, length(split_part(text, chr(10), 1)) + 2) AS rest FROM documents)
JOIN events ON event_id = (doc_id * 7919) % (SELECT count(*) FROM events)
JOIN pages ON page_id = doc_id % (SELECT count(*) FROM pages)
""")

_view("tagged", f"""
SELECT *, len(m_companies) > 0 OR len(m_keywords) > 0 OR len(m_countries) >= 2 AS passed,
  CASE WHEN list_contains(m_keywords, 'sich') THEN 'sanction' WHEN list_contains(m_keywords, 'para') THEN 'trade'
       WHEN len(m_companies) > 0 THEN 'supply_chain' ELSE 'none' END AS relation_type,
  CAST(least(10, len(m_countries) + 2 * len(m_companies) + 2 * len(m_keywords) + 4) AS DOUBLE) / CAST(10 AS DOUBLE) AS confidence,
  CASE WHEN seq % 13 = 0 THEN 'timeout' END AS error, CASE WHEN seq % 5 = 0 THEN 'backup' ELSE 'primary' END AS model
FROM (
  SELECT h.*, o.* EXCLUDE (source_id), {terms("lc", ["rewh", "inoran", "nicht"])} AS m_countries,
    {terms("lc", ["license", "erenan"])} AS m_companies, {terms("lc", ["para", "sich"])} AS m_keywords
  FROM (SELECT *, lower(replace(full_text, 'İ', 'i')) AS lc FROM headline) h JOIN outlet o USING (source_id))
""", ["outlet", "headline"])

_view("audit", """
SELECT seq, edition_date, name AS source, country, title, link,
  CASE WHEN NOT passed THEN 'prefilter_rejected' WHEN error IS NOT NULL THEN 'classifier_error'
       WHEN relation_type <> 'none' THEN 'accepted' ELSE 'classifier_rejected' END AS stage,
  CASE WHEN NOT passed THEN 'no menciona dos o más países, una empresa multinacional de la lista ni una palabra clave de comercio/tratados'
       WHEN error IS NOT NULL THEN error ELSE concat('regla ', relation_type) END AS reason,
  CASE WHEN passed AND error IS NULL THEN relation_type END AS relation_type,
  CASE WHEN passed AND error IS NULL THEN model END AS model,
  CASE WHEN passed AND error IS NULL THEN confidence END AS confidence
FROM tagged
""", ["tagged"])

_view("notes", r"""
SELECT *, CASE WHEN wire IS NOT NULL THEN concat('cable:', wire) WHEN ownership = 'estatal' THEN concat('estatal:', country)
               ELSE concat('medio:', source_id) END AS voice,
  coalesce(signature, concat('singleton:', seq)) AS cluster_key
FROM (
  SELECT seq, edition_date, source_id, name, country, region, stance, ownership, ownership_note, title, snippet, link,
    m_companies AS companies, m_countries AS countries, relation_type,
    CASE WHEN regexp_matches(full_text, '\bpour\b') THEN 'W1' WHEN regexp_matches(full_text, '\bwith\b') THEN 'W2'
         WHEN regexp_matches(full_text, '\bund\b|Outlet 4') AND NOT regexp_matches(name, '\bund\b|Outlet 4') THEN 'W3' END AS wire,
    CASE WHEN len(m_companies) > 0 THEN concat('company:', array_to_string(list_sort(m_companies), '+'), '|', relation_type)
         WHEN len(m_countries) > 0 THEN concat('countries:', array_to_string(list_sort(m_countries), '+'), '|', relation_type) END AS signature
  FROM tagged WHERE passed AND error IS NULL AND relation_type <> 'none')
""", ["tagged"])

_view("clusters", """
SELECT *, voices + 2 * voice_countries AS weight FROM (
  SELECT edition_date, cluster_key, count(*) AS notes, min(seq) AS first_seq, count(DISTINCT source_id) AS sources,
    count(DISTINCT country) AS countries, count(DISTINCT voice) AS voices,
    count(DISTINCT CASE WHEN wire IS NULL THEN country END) AS voice_countries
  FROM notes GROUP BY ALL)
""", ["notes"])

_view("wire_text", """
SELECT edition_date, cluster_key, string_agg(concat(wire, ' en ', n, ' medios'), ', ' ORDER BY wire) AS wires,
  CAST(sum(n) AS BIGINT) AS wire_notes, CAST(sum(o) AS BIGINT) AS wire_outlets
FROM (SELECT edition_date, cluster_key, wire, count(*) AS n, count(DISTINCT source_id) AS o FROM notes
      WHERE wire IS NOT NULL GROUP BY ALL) GROUP BY ALL
""", ["notes"])

_view("ranked", """
SELECT *, row_number() OVER (PARTITION BY edition_date ORDER BY weight DESC, first_seq) AS rank FROM clusters
""", ["clusters"])

_view("cross_story", """
SELECT r.*, media_countries, coalesce(wires, '') AS wires, n.title
FROM ranked r
JOIN (SELECT edition_date, cluster_key, string_agg(country, ', ' ORDER BY seen_at) AS media_countries
      FROM (SELECT edition_date, cluster_key, country, min(seq) AS seen_at FROM notes GROUP BY ALL) GROUP BY ALL)
  USING (edition_date, cluster_key)
LEFT JOIN wire_text USING (edition_date, cluster_key)
JOIN notes n ON n.seq = r.first_seq
WHERE sources > 1
""", ["ranked", "wire_text", "notes"])

_view("measured", """
SELECT n.*, c.sources AS cluster_sources, c.countries AS cluster_countries, c.voices AS cluster_voices, c.weight
FROM notes n JOIN clusters c USING (edition_date, cluster_key)
""", ["notes", "clusters"])

_view("region_ranked", """
SELECT *, row_number() OVER (PARTITION BY edition_date, region ORDER BY weight DESC, seq) AS region_rank,
  CASE WHEN cluster_sources > 1 THEN concat(' [cobertura: ', cluster_sources, ' medios, ', cluster_countries, ' país(es), ',
       cluster_voices, ' fuentes independientes]') ELSE '' END AS coverage
FROM measured
""", ["measured"])

_view("numbered", "SELECT *, row_number() OVER (PARTITION BY edition_date ORDER BY seq) AS n FROM notes", ["notes"])

_view("digest_number", "SELECT edition_date, seq, cluster_key, max(n) OVER (PARTITION BY edition_date, source_id, title) AS n FROM numbered", ["numbered"])

_view("region_dim", """
SELECT * FROM (VALUES ('north_america', 'América del Norte', 1), ('latin_america', 'América Latina', 2), ('europe', 'Europa', 3),
  ('east_asia', 'Asia Oriental', 4), ('eurasia', 'Eurasia', 5), ('middle_east', 'Medio Oriente', 6), ('africa', 'África', 7),
  ('oceania', 'Oceanía', 8)) v(region, label, rank)
""")

_view("edition_cov", """
SELECT e.edition_date, d.region, d.label, d.rank, coalesce(configured, 0) AS configured, coalesce(responded, 0) AS responded,
  coalesce(configured, 0) > 0 AND coalesce(responded, 0) * 2 < coalesce(configured, 0) AS low,
  CASE WHEN coalesce(configured, 0) > 0 AND coalesce(responded, 0) * 2 < coalesce(configured, 0)
       THEN concat('Cobertura insuficiente hoy (', coalesce(responded, 0), ' de ', coalesce(configured, 0), ' medios respondieron).')
       ELSE 'Sin novedades relevantes hoy.' END AS empty_text
FROM (SELECT DISTINCT edition_date FROM headline) e, region_dim d
LEFT JOIN (SELECT region, count(*) AS configured FROM outlet WHERE has_feed GROUP BY ALL) c ON c.region = d.region
LEFT JOIN (SELECT edition_date, region, count(DISTINCT source_id) AS responded FROM headline JOIN outlet USING (source_id)
           WHERE has_feed GROUP BY ALL) r ON r.edition_date = e.edition_date AND r.region = d.region
""", ["headline", "outlet", "region_dim"])

_view("usage_event", """
SELECT event_id, CAST(ts AS DATE) AS run, CASE event_type WHEN 'view' THEN 'clasificacion' WHEN 'click' THEN 'agrupamiento'
  WHEN 'purchase' THEN 'redaccion' WHEN 'signup' THEN 'fidelidad' END AS stage,
  CAST(CAST(value AS DECIMAL(18,2)) AS DECIMAL(18,6)) / 1000 AS cost_raw,
  CAST(CAST(value AS DECIMAL(18,2)) * 0.001 AS DECIMAL(18,6)) AS cost,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS prompt_tokens, event_id % 100 AS completion_tokens
FROM events
""")

_view("versions", """
SELECT edition_date, event_id, generated_at, version, CASE WHEN version = 1 THEN 'edición original'
  WHEN event_id % 2 = 0 THEN 'regenerada sin motivo declarado' ELSE concat('motivo ', event_id) END AS reason
FROM (SELECT event_id, CAST(ts AS DATE) AS edition_date, ts AS generated_at,
        row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS version
      FROM events WHERE event_type = 'error')
""")

_view("prediction", """
SELECT doc_id, quality = 1 AS expected, doc_id % 13 = 0 AS error, unnest(['len', 'lang']) AS model,
  unnest([n_chars >= 2000, lang = 'en']) AS predicted
FROM documents JOIN labels USING (doc_id)
""")

_view("vote", """
SELECT doc_id AS id, unnest(['j1', 'j2', 'j3']) AS judge, unnest([quality = 1, (quality = 1) <> (doc_id % 10 = 0),
  CASE WHEN doc_id % 17 <> 0 THEN (quality = 1) <> (doc_id % 15 = 0) END]) AS vote
FROM labels
""")

_LABELS = "['América del Norte','América Latina','Europa','Asia Oriental','Eurasia','Medio Oriente','África','Oceanía']"


def _label(k: int) -> str:
    return f"{_LABELS}[(d + i + {k}) % 8 + 1]"


# Lambda indexes start at 1 here, so i stands for (j - 1).
_PIECE = f"""CASE i % 9
 WHEN 0 THEN concat(mark, ' Resumen ejecutivo', nl, nl, x, ' [', (d*7+i*3)%9+1, ', ', (d+i)%40+1, '].')
 WHEN 1 THEN concat('## Resumen por región', nl, nl, '### ', {_label(0)}, nl, nl, x, ' [', (d*7+i*3)%9+1, '].')
 WHEN 2 THEN concat('- ', x, ' [', (d*7+i*3)%9+1, '][', (d+i)%40+1, ']')
 WHEN 3 THEN concat('- ', x)
 WHEN 4 THEN concat('### ', {_label(1)}, nl, nl, 'Sin novedades relevantes hoy.', nl, nl, '---', nl, '### ', {_label(2)}, nl, nl, '- ', x, ' [', (d*7+i*3)%9+1, ']')
 WHEN 5 THEN concat('## Clima internacional', nl, nl, 'ver [fuente](', link, ') y [otra](https://otro.example/', d, '/', i, ') ', x)
 WHEN 6 THEN concat('## Empresas potencialmente afectadas', nl, nl, '- ', x, ' [', (d+i)%40+1, '] ![x](https://tracker.example/p.gif)')
 WHEN 7 THEN concat(x, ' <https://otro.example/', d, '> https://otro.example/', i)
 ELSE concat('* ', x, ' [9999]') END"""

_view("report", f"""
SELECT d AS report_id, any_value(edition_date) AS edition_date,
  concat(string_agg(piece, chr(10) ORDER BY i), CASE WHEN d % 3 <> 0 THEN concat(any_value(nl), any_value(nl), '## Noticias utilizadas', any_value(nl),
    string_agg(entry, '' ORDER BY i)) ELSE '' END) AS markdown
FROM (
  SELECT *, {_PIECE} AS piece,
    concat(CASE WHEN i % 4 = 0 THEN concat(nl, '### ', {_label(0)}, nl, nl) ELSE '' END, '- [', {escape_link_text("x")},
      '](<https://', source_id, '.example/', d, '/', i, '>) — ', name, ' (', country, ')', nl) AS entry
  FROM (SELECT seq AS d, edition_date, source_id, link, name, country, chr(10) AS nl,
          CASE WHEN seq % 5 = 0 THEN '#' ELSE '##' END AS mark,
          unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
        FROM headline JOIN outlet USING (source_id)))
GROUP BY d
""", ["headline", "outlet"])

_view("section", rf"""
SELECT report_id, edition_date, i AS section_no, {strip("split_part(p, chr(10), 1)")} AS heading,
  {strip("substr(p, length(split_part(p, chr(10), 1)) + 1)")} AS body
FROM (SELECT report_id, edition_date, unnest(string_split(concat(chr(10), markdown), concat(chr(10), '## '))[2:]) AS p,
        generate_subscripts(string_split(concat(chr(10), markdown), concat(chr(10), '## '))[2:], 1) AS i FROM report)
WHERE p <> ''
""", ["report"])

_view("body_line", rf"""
SELECT report_id, edition_date, i, j, section, {strip("x")} AS t FROM (
  SELECT report_id, edition_date, i, CASE WHEN i = 1 THEN '' ELSE {strip("split_part(p, chr(10), 1)")} END AS section,
    unnest(string_split(CASE WHEN i = 1 THEN p ELSE substr(p, length(split_part(p, chr(10), 1)) + 1) END, chr(10))) AS x,
    generate_subscripts(string_split(CASE WHEN i = 1 THEN p ELSE substr(p, length(split_part(p, chr(10), 1)) + 1) END, chr(10)), 1) AS j
  FROM (SELECT report_id, edition_date, unnest(string_split_regex(concat(chr(10), markdown), '\n[ \t\r\f]*## ')) AS p,
          generate_subscripts(string_split_regex(concat(chr(10), markdown), '\n[ \t\r\f]*## '), 1) AS i FROM resolved_report))
WHERE section <> 'Noticias utilizadas' AND {strip("x")} <> '' AND NOT starts_with({strip("x")}, '#')
""", ["resolved_report"])

_view("cite_token", r"""
SELECT report_id, edition_date, pos, tok, regexp_matches(tok, '^\[\d[\d,\s]*\]$') AS cite FROM (
  SELECT report_id, edition_date, unnest(regexp_extract_all(markdown, '\[\d+(?:\s*,\s*\d+)*\]\(?|[^\[]+|\[')) AS tok,
    generate_subscripts(regexp_extract_all(markdown, '\[\d+(?:\s*,\s*\d+)*\]\(?|[^\[]+|\['), 1) AS pos FROM report)
""", ["report"])

_view("cite_number", r"""
SELECT report_id, edition_date, pos, k, TRY_CAST(num AS BIGINT) AS n FROM (
  SELECT report_id, edition_date, pos, unnest(regexp_extract_all(tok, '\d+')) AS num,
    generate_subscripts(regexp_extract_all(tok, '\d+'), 1) AS k FROM cite_token WHERE cite)
""", ["cite_token"])

_view("resolved_report", """
SELECT t.report_id, any_value(t.edition_date) AS edition_date,
  string_agg(CASE WHEN cite THEN coalesce(shown, '') ELSE tok END, '' ORDER BY t.pos) AS markdown,
  CAST(sum(coalesce(good, 0)) AS BIGINT) AS resolved, CAST(sum(coalesce(bad, 0)) AS BIGINT) AS invalid
FROM cite_token t LEFT JOIN (
  SELECT c.report_id, c.pos, string_agg(CASE WHEN m.n IS NULL THEN '' WHEN m.link = '' THEN concat('[', c.n, ']')
      ELSE concat('[[', c.n, ']](<', m.link, '>)') END, '' ORDER BY k) AS shown,
    count(m.n) AS good, count(*) - count(m.n) AS bad
  FROM cite_number c LEFT JOIN numbered m ON m.edition_date = c.edition_date AND m.n = c.n GROUP BY ALL) r
ON r.report_id = t.report_id AND r.pos = t.pos
GROUP BY t.report_id
""", ["cite_token", "cite_number", "numbered"])

_view("claim", rf"""
SELECT report_id, edition_date, CAST(row_number() OVER (PARTITION BY report_id ORDER BY i, j) - 1 AS INTEGER) AS claim_no, section,
  regexp_replace(regexp_replace({strip(r"regexp_replace(t, '\[\[(\d+)\]\]\(<([^>]*)>\)', '', 'g')")}, '^- ', ''), '^\* ', '') AS text,
  list_transform(regexp_extract_all(t, '\[\[(\d+)\]\]\(<([^>]*)>\)', 1), lambda v: CAST(v AS BIGINT)) AS all_nums,
  regexp_extract_all(t, '\[\[(\d+)\]\]\(<([^>]*)>\)', 2) AS links
FROM body_line WHERE regexp_matches(t, '\[\[(\d+)\]\]\(<([^>]*)>\)')
""", ["body_line"])

_view("claim_num", """
SELECT report_id, edition_date, claim_no, n, min(k) AS k FROM (
  SELECT report_id, edition_date, claim_no, unnest(all_nums) AS n, generate_subscripts(all_nums, 1) AS k FROM claim) GROUP BY ALL
""", ["claim"])

_LINK = r"""!?\[([^\]]*)\]\(([^)\s]*)(?:\s+"[^"]*")?\)|<(https?://[^>\s]+)>|https?://[^\s<>()\[\]]+"""
_TOKENS = _LINK + r"|[^!\[<h]+|[\s\S]"

_view("link_token", rf"""
SELECT *, regexp_matches(tok, '^!?\[[^\]]*\]\(') AS md,
  CASE WHEN regexp_matches(tok, '^!?\[[^\]]*\]\(') THEN regexp_extract(tok, '!?\[([^\]]*)\]\(([^)\s]*)(?:\s+"[^"]*")?\)', 2)
       WHEN regexp_matches(tok, '^<https?://') THEN regexp_extract(tok, '<(https?://[^>\s]+)>', 1)
       WHEN regexp_matches(tok, '^https?://') THEN tok END AS url
FROM (SELECT report_id, edition_date, unnest(regexp_extract_all(markdown, '{_TOKENS}')) AS tok,
        generate_subscripts(regexp_extract_all(markdown, '{_TOKENS}'), 1) AS pos FROM report)
""", ["report"])

_view("note_link", "SELECT DISTINCT edition_date, trim(link) AS url FROM notes WHERE trim(link) <> ''", ["notes"])

_view("batch_item", """
SELECT *, CAST((rn - 1) // 16 AS BIGINT) AS batch_no, CAST((rn - 1) % 16 AS INTEGER) AS item_index FROM (
  SELECT seq, edition_date, title, snippet, passed, relation_type, confidence, m_countries, m_companies,
    row_number() OVER (PARTITION BY edition_date ORDER BY seq) AS rn FROM tagged)
""", ["tagged"])

_view("answer", """
SELECT b.*, p.provider_rank,
  CASE WHEN (batch_no + provider_rank + day(edition_date)) % 4 = 0 THEN 'error'
       WHEN (seq + provider_rank) % 10 = 3 THEN 'missing' ELSE 'ok' END AS status
FROM batch_item b, (VALUES (1), (2), (3)) p(provider_rank)
""", ["batch_item"])

# All pairs of titles of an edition of whose words half agree.
_view("title_words", r"""
SELECT edition_date, seq, list_distinct(regexp_extract_all(lower(replace(title, 'İ', 'i')), '[\p{L}\p{N}]+')) AS w FROM headline
""", ["headline"])

_view("title_edge", """
SELECT a.edition_date, a.seq AS x, b.seq AS y FROM title_words a JOIN title_words b USING (edition_date)
WHERE a.seq <> b.seq AND len(a.w) > 0 AND len(b.w) > 0 AND 2 * len(list_intersect(a.w, b.w)) >= len(list_distinct(list_concat(a.w, b.w)))
""", ["title_words"])

_view("same_event_reach", """
SELECT edition_date, seq, seq AS root FROM headline
UNION
SELECT r.edition_date, r.seq, e.y FROM same_event_reach r JOIN title_edge e ON e.edition_date = r.edition_date AND e.x = r.root
""", ["headline", "title_edge"])

_ITEM = """CASE no % 3
 WHEN 0 THEN concat('<item><title>', xt, '</title><link>', xl, '</link><guid isPermaLink="false">id-', seq, '</guid><atom:link href="https://alt.example/', seq,
   '"/><description>', xs, '</description><pubDate>', coalesce(strftime(published_at, '%a, %d %b %Y %H:%M:%S +0000'), ''), '</pubDate></item>')
 WHEN 1 THEN concat('<entry><title type="html">', xt, '</title><link href="https://self.example/', seq, '" rel="self"/><link href="', xl, '" rel="alternate"/><summary>', xs,
   '</summary><published>', coalesce(strftime(published_at, '%Y-%m-%dT%H:%M:%SZ'), ''), '</published></entry>')
 ELSE concat('<item><title>', xt, '</title><link>', xl, '</link><description>', xs, '</description><dc:date>', coalesce(strftime(published_at, '%Y-%m-%d'), ''), '</dc:date></item>') END"""


def _xml(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_view("feed_item", f"""
SELECT *, (feed_pos - 1) // 25 AS fetch_no, (feed_pos - 1) % 25 + 1 AS pos, {_xml("whole_title")} AS xt, {_xml("whole_rest")} AS xs, {_xml("link")} AS xl,
  (day(edition_date) + no) % 7 AS kind
FROM (SELECT seq, source_id, edition_date, no, title, snippet, whole_title, whole_rest, link, published_at, row_number() OVER (PARTITION BY source_id, edition_date ORDER BY seq) AS feed_pos
      FROM headline JOIN outlet USING (source_id))
""", ["headline", "outlet"])

_view("payload", f"""
SELECT source_id, edition_date, CAST(fetch_no AS BIGINT) AS fetch_no, CASE WHEN kind = 4 THEN 'koi8-r' WHEN kind = 5 AND latin THEN 'iso-8859-1' ELSE 'utf-8' END AS enc, kind,
  CASE WHEN kind = 3 THEN '<html><body>503</body></html>' ELSE concat('<?xml version="1.0" encoding="',
    CASE WHEN kind = 4 THEN 'koi8-r' WHEN kind = 5 AND latin THEN 'iso-8859-1' ELSE 'utf-8' END, '"?>',
    CASE no % 3 WHEN 0 THEN '<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom"><channel><title>f</title>' WHEN 1 THEN '<feed xmlns="http://www.w3.org/2005/Atom">'
      ELSE '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>f</title></channel>' END,
    items, CASE no % 3 WHEN 0 THEN '</channel></rss>' WHEN 1 THEN '</feed>' ELSE '</rdf:RDF>' END) END AS xml
FROM (SELECT source_id, edition_date, fetch_no, no, kind, items, regexp_full_match(items, '[\\x{{0}}-\\x{{FF}}]*') AS latin FROM (
  SELECT source_id, edition_date, fetch_no, no, kind, string_agg({_ITEM}, '' ORDER BY pos) AS items FROM feed_item GROUP BY ALL))
""", ["feed_item"])

_view("parsed_feed", """
SELECT seq, source_id, edition_date, CAST(fetch_no AS BIGINT) AS fetch_no, CAST(pos AS INTEGER) AS feed_pos, title,
  CASE WHEN no % 3 = 0 AND link = '' THEN concat('https://alt.example/', seq) ELSE link END AS link, snippet,
  CASE WHEN no % 3 = 2 THEN CAST(CAST(published_at AS DATE) AS TIMESTAMP) ELSE date_trunc('second', published_at) END AS published_at
FROM feed_item WHERE kind NOT IN (3, 4)
""", ["feed_item"])
