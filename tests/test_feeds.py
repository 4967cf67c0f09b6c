"""Feeds built from the format specifications with a seed, and what a reader must make of them."""

import datetime
import random
from email.utils import format_datetime
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from newslens.sources import feeds

PROLOG = '<?xml version="1.0" encoding="UTF-8"?>'
LETTERS = "abcdefghij klmnop qrstu ÄÖßéñ&<>\"' "


def phrase(rng, n=12):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(n)).split()) or "x"


def story(rng, i):
    when = datetime.datetime(2019, 3, 1, tzinfo=datetime.timezone(datetime.timedelta(hours=rng.randrange(-11, 12)))) + datetime.timedelta(seconds=rng.randrange(10**8))
    return {"title": phrase(rng), "snippet": phrase(rng, 40), "link": f"https://site{i}.test/p?q={i}&r={rng.randrange(99)}", "when": when}


def rss(stories):
    items = "".join(
        f"<item><description>{escape(s['snippet'])}</description><title>{escape(s['title'])}</title><pubDate>{format_datetime(s['when'])}</pubDate>"
        f"<link>{escape(s['link'])}</link></item>" for s in stories
    )
    return f'{PROLOG}<rss version="2.0"><channel><link>https://site.test</link>{items}</channel></rss>'


def atom(stories):
    items = "".join(
        f"<entry><published>{s['when'].isoformat()}</published><title>{escape(s['title'])}</title><link rel=\"enclosure\" href=\"https://cdn.test/x.mp3\"/>"
        f"<link href=\"{escape(s['link'])}\"/><summary>{escape(s['snippet'])}</summary></entry>" for s in stories
    )
    return f'{PROLOG}<feed xmlns="http://www.w3.org/2005/Atom"><id>urn:x</id>{items}</feed>'


def rdf(stories):
    items = "".join(
        f"<item><link>{escape(s['link'])}</link><title>{escape(s['title'])}</title><description>{escape(s['snippet'])}</description><dc:date>{s['when'].isoformat()}</dc:date></item>"
        for s in stories
    )
    space = 'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/"'
    return f"{PROLOG}<rdf:RDF {space}><channel><title>c</title></channel>{items}</rdf:RDF>"


def payloads(spark, bodies, **limits):
    rows = [(k, bytearray(b if isinstance(b, bytes) else b.encode())) for k, b in bodies.items()]
    return feeds.mark_rejected(spark.createDataFrame(rows, "source_id string, body binary"), **limits)


def test_every_format_gives_its_stories_back(spark):
    rng = random.Random(17)
    wrote = {f"{build.__name__}{n}": (build, [story(rng, i) for i in range(n)]) for build in (rss, atom, rdf) for n in (1, 4, 30)}
    parsed = feeds.parse_feeds(payloads(spark, {k: build(x) for k, (build, x) in wrote.items()}), None)
    got = {(r.source_id, r.feed_pos): (r.title, r.snippet, r.link, r.published_at) for r in parsed.collect()}
    want = {
        (k, i): (s["title"], s["snippet"], s["link"], s["when"].astimezone(datetime.timezone.utc).replace(tzinfo=None))
        for k, (_, x) in wrote.items() for i, s in enumerate(x, 1)
    }
    assert got == want
    cut = feeds.parse_feeds(payloads(spark, {"a": rss(wrote["rss30"][1])}), 7)
    assert sorted(r.feed_pos for r in cut.collect()) == list(range(1, 8))


@pytest.mark.parametrize(
    ("inside", "link"),
    [
        ('<link/><a:link href="https://h.test/only"/>', "https://h.test/only"), ("<guid>https://g.test/id</guid>", "https://g.test/id"),
        ("<link>ftp://no.test</link><guid>https://g.test/id</guid>", "https://g.test/id"), ("<guid>urn:uuid:9</guid>", ""), ("", ""),
    ],
)
def test_links_of_an_item(spark, inside, link):
    body = f'{PROLOG}<rss xmlns:a="http://www.w3.org/2005/Atom"><channel><item><title>t</title>{inside}</item></channel></rss>'
    assert feeds.parse_feeds(payloads(spark, {"x": body})).first().link == link


@pytest.mark.parametrize("name", ["ISO-8859-1", "latin1", "Windows-1252"])
@pytest.mark.parametrize("filler", ["", " " * 900])
def test_charsets_named_anywhere_in_the_prolog(spark, name, filler):
    text = f"<?xml version='1.0'{filler} encoding='{name}'?><rss><channel><item><title>Žádné? Façade über Ñandú</title></item></channel></rss>".replace("Ž", "Z")
    got = feeds.parse_feeds(payloads(spark, {"x": text.replace("á", "a").encode("latin-1")})).first()
    assert got.title == "Zadné? Façade über Ñandú"


def test_payloads_without_stories(spark):
    good = rss([story(random.Random(1), 1)])
    bodies = {"good": good, "cut": good[: len(good) // 2], "page": "<html><p>503</p></html>", "cyrillic": '<?xml version="1.0" encoding="KOI8-R"?><rss/>',
              "bytes": b"<rss>\xfe\xff</rss>", "empty": "", "large": good + " " * 5000}
    p = payloads(spark, bodies, max_body=4000)
    why = {r.source_id: r.detail for r in feeds.feed_failures(p, feeds.parse_feeds(p)).collect()}
    parse, charset = "feed did not parse as RSS2, Atom or RDF", "unsupported charset"
    assert why == {"cut": parse, "page": parse, "cyrillic": charset, "bytes": charset, "empty": parse, "large": "payload too large"}
    outlets = spark.createDataFrame([(k, k != "page") for k in bodies], "source_id string, has_feed boolean")
    smoke = feeds.feed_smoke(outlets, feeds.parse_feeds(p))
    assert {r.source_id: r.state for r in smoke.collect()} == {k: "ok" if k == "good" else "skipped" if k == "page" else "failed" for k in bodies}
    assert tuple(feeds.smoke_totals(smoke).first()) == (7, 1, 5, 1)


def test_payload_files(spark, tmp_path):
    for k, body in {"north.daily": rss([story(random.Random(2), 1)]), "south": "x" * 300}.items():
        (tmp_path / f"{k}.xml").write_text(body)
    assert {r.source_id: r.rejected for r in feeds.read_payloads(spark, str(tmp_path), 250).collect()} == {"north": True, "south": True}
    assert not any(r.rejected for r in feeds.read_payloads(spark, str(tmp_path)).collect())


def test_editions(spark, tmp_path):
    from newslens.sources import editions

    (tmp_path / "2026-01-02.md").write_text("## A\n\nx")
    (tmp_path / "2026-01-03.md").write_text("## B")
    (tmp_path / "notas.md").write_text("no")
    (tmp_path / "2026-01-02.sources.json").write_text('[{"name":"M","country":"P"}]')
    docs = editions.read_edition_files(spark, str(tmp_path))
    assert {str(r.edition_date): r.markdown for r in docs.collect()} == {"2026-01-02": "## A\n\nx", "2026-01-03": "## B"}
    joined = editions.edition_join(docs, editions.read_outlet_files(spark, str(tmp_path)), spark.createDataFrame([], "edition_date date, accepted int"))
    assert {str(r.edition_date): r.source_count for r in joined.collect()} == {"2026-01-02": 1, "2026-01-03": 0}
    assert str(editions.latest_edition(docs).first().edition_date) == "2026-01-03"
    out = str(tmp_path / "sink")
    editions.write_editions(docs, out)
    editions.write_editions(docs.where("edition_date = '2026-01-03'").withColumn("markdown", F.lit("nuevo")), out)
    back = editions.read_editions(spark, out, "markdown string, edition_date date")
    assert {str(r.edition_date): r.markdown for r in back.collect()} == {"2026-01-02": "## A\n\nx", "2026-01-03": "nuevo"}


def test_yaml_outlets(spark, tmp_path):
    """Good and bad entries, files that cannot be read as a list, several files, and the same by the data source and as texts."""
    from newslens.sources import outlets, yaml_files

    folder = tmp_path / "lists"
    folder.mkdir()
    (folder / "a.yaml").write_text(
        'sources:\n  - id: a\n    name: A\n    country: no\n    rss: "https://e.org"\n    extra: 1\n  - id: 007\n    name: ~\n    rss: NO_RSS\n'
        "  - just text\n  - name: X\n  - id: a\n  - id: c\n    name: [1, 2]\n  - {id: d, country: 'México'}\n",
        encoding="utf-8",
    )
    (folder / "b.yml").write_text("sources: 5\n")
    (folder / "c.yaml").write_text("sources:\n  - id: [\n")
    (folder / "d.yaml").write_text("")
    (folder / "e.yaml").write_text("sources:\n")
    (folder / "_hidden").write_text("sources: 1")
    yaml_files.register(spark)
    rows = spark.read.format("outlets_yaml").load(str(folder)).collect()
    good = {r.id: r for r in rows if r.problem is None}
    assert {k: (r.name, r.country, r.rss) for k, r in good.items()} == {
        "a": ("A", "no", "https://e.org"), "007": (None, None, "NO_RSS"), "d": (None, "México", None),
    }
    problems = sorted(r.problem for r in rows if r.problem)
    assert problems[:4] == ["entry 3: no fields", "entry 4: no id", "entry 5: id a again", "entry 6: name is no text"]
    assert problems[4].startswith("line ") and problems[5] == "no list of sources" and len(problems) == 6
    assert all(r.id is None for r in rows if r.problem)
    assert sorted(map(repr, outlets.outlet_entries(spark, str(folder)).collect())) == sorted(map(repr, rows))
    one = outlets.read_outlets(spark, str(folder / "a.yaml"))
    assert {r.source_id: r.has_feed for r in one.collect()} == {"a": True, "007": False, "d": False}
    assert spark.read.format("outlets_yaml").load(str(folder / "d.yaml")).count() == 0
    got = spark.read.format("gazetteer_yaml").load(str(folder / "b.yml")).collect()
    assert got == []


def test_config_files(spark, tmp_path):
    from newslens.sources import evalset, gazetteer, outlets

    (tmp_path / "o.json").write_text('{"id":"a","name":"A","rss":"https://e.org"}\n{"id":"b","name":"B","rss":"NO_RSS"}\n{"id":"c","name":"C"}\n')
    assert {r.source_id: r.has_feed for r in outlets.read_outlets(spark, str(tmp_path / "o.json")).collect()} == {"a": True, "b": False, "c": False}
    (tmp_path / "g.json").write_text('{"countries": ["X", "Y"],\n "keywords": ["k"]}')
    assert sorted(map(tuple, gazetteer.read_gazetteer(spark, str(tmp_path / "g.json")).collect())) == [("countries", "X"), ("countries", "Y"), ("keywords", "k")]
    (tmp_path / "g.yaml").write_text("countries:\n  - no\n  - 12\n  # more\n  - U.S.\nkeywords: [k, 'a: b', '']\ncompanies:\n")
    assert sorted(map(tuple, gazetteer.read_gazetteer(spark, str(tmp_path / "g.yaml")).collect())) == [
        ("countries", "12"), ("countries", "U.S."), ("countries", "no"), ("keywords", "a: b"), ("keywords", "k"),
    ]
    (tmp_path / "e.jsonl").write_text('{"id":"1","title":"t","expected":true}\n\n{"id":"2","expected":false}\n')
    assert [r.expected for r in evalset.read_examples(spark, str(tmp_path / "e.jsonl")).orderBy("id").collect()] == [True, False]
