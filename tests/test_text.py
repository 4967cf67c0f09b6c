import datetime

import pytest
from pyspark.sql import functions as F

from newslens.functions import regions, text, wires
from newslens.functions.modeljson import CLASSIFICATION_SCHEMA, error_class, extract_json, parse_model_json


def value(spark, fn, *args):
    df = spark.createDataFrame([tuple(args)], ", ".join(f"c{i} string" for i in range(len(args))))
    return df.select(fn(*[F.col(f"c{i}") for i in range(len(args))]).alias("r")).first()["r"]


def test_clean_text_against_a_walk(spark):
    import random
    import unicodedata

    rng = random.Random(31)
    signs = "ab éß漢 \t\n\r\u00a0\u2003\x07\x7f. "
    raws = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 40))) for _ in range(60)] + ["ü " * 90, "w" * 51, "", " "]

    def plain(raw, limit):
        out = "".join(" " if unicodedata.category(c)[0] == "Z" or unicodedata.category(c) == "Cc" else c for c in raw)
        out = " ".join(x for x in out.split(" ") if x)
        return out if len(out) <= limit else out[: limit - 1].rstrip(" ") + "…"

    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, c string")
    got = [r.t for r in df.select("i", text.clean_text(F.col("c"), 50).alias("t")).orderBy("i").collect()]
    assert got == [plain(r, 50) for r in raws]


def test_clean_link_keeps_web_addresses_only(spark):
    import itertools

    for scheme, host, tail in itertools.product(["http", "https", "HtTp", "ftp", "mailto", "vbscript"], ["news.test", ""], ["", "/a/b?c=1#d"]):
        raw = f"\n {scheme}://{host}{tail}\t"
        want = f"{scheme.lower()}://{host}{tail}" if scheme.lower() in ("http", "https") and host else ""
        assert value(spark, text.clean_link, raw) == want, raw


def test_fractions_of_any_length(spark):
    for n in range(1, 10):
        digits = "123456789"[:n]
        want = datetime.datetime(2031, 5, 6, 7, 8, 9, int(digits[:6].ljust(6, "0")))
        assert value(spark, text.parse_pubdate, f"2031-05-06T07:08:09.{digits}Z") == want


@pytest.mark.parametrize("raw, when", [
    ("Mon, 02 Jan 2006 15:04:05 -0700", datetime.datetime(2006, 1, 2, 22, 4, 5)), ("Mon, 02 Jan 2006 15:04:05 GMT", datetime.datetime(2006, 1, 2, 15, 4, 5)),
    ("2006-01-02T15:04:05Z", datetime.datetime(2006, 1, 2, 15, 4, 5)), ("2006-01-02T15:04:05.250+09:00", datetime.datetime(2006, 1, 2, 6, 4, 5, 250000)),
    ("2018-01-24", datetime.datetime(2018, 1, 24)), ("2018-01-24 10:11:12", datetime.datetime(2018, 1, 24, 10, 11, 12)), ("ayer", None), ("", None),
])
def test_parse_pubdate(spark, raw, when):
    assert value(spark, text.parse_pubdate, raw) == when


def test_parse_pubdate_ignores_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert value(spark, text.parse_pubdate, "2018-01-24 10:11:12") == datetime.datetime(2018, 1, 24, 10, 11, 12)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_reading_minutes(spark):
    body = "## A\n\n" + "palabra " * 400 + "[[1]](<https://x>)\n\n## Noticias utilizadas\n\n" + "nota " * 1000
    assert value(spark, text.reading_minutes, body) == 2
    assert value(spark, text.reading_minutes, "una") == 1


def test_date_label(spark):
    assert value(spark, text.date_label_es, "2026-09-23") == "miércoles, 23 de septiembre de 2026"
    assert value(spark, text.date_label_es, "ayer") == "ayer"
    assert value(spark, text.date_label_es, "2026-02-31") == "2026-02-31"


@pytest.mark.parametrize("raw, email", [
    ("  Ana@Mail.ORG ", "ana@mail.org"), ("sin-arroba", None), ("", None), ("a@@b.org", None), ("Ana <a@b.org>", None), ("a" * 250 + "@b.org", None),
])
def test_normalize_email(spark, raw, email):
    assert value(spark, text.normalize_email, raw) == email


def test_client_key(spark):
    assert value(spark, text.client_key, "1.1.1.1, 2.2.2.2", "9.9.9.9:1") == "2.2.2.2"
    assert value(spark, text.client_key, "1.1.1.1, ", "9.9.9.9:1") == "9.9.9.9"
    assert value(spark, text.client_key, None, "[::1]:80") == "::1"


def test_host(spark):
    assert value(spark, text.host_of, "https://www.E.org:8080/a") == "e.org"
    assert value(spark, text.host_of, "no url") == "no url"


def test_lower_and_sets(spark):
    assert value(spark, text.lower_simple, "İX") == "ix"
    assert value(spark, lambda c: F.array_join(text.normalize_set(F.split(c, ",")), "|"), " B,a,b ,,A") == "a|b"


@pytest.mark.parametrize("note, outlet, wire", [
    ("El acuerdo, según Reuters", "Diario", "Reuters"), ("日Reuters informa", "Diario", "Reuters"), ("preuters", "Diario", None),
    ("Anadolu y EFE", "Agencia Anadolu", "EFE"), ("PARIS (AP) x", "Diario", "AP"), ("WASHINGTON AP — x", "Diario", "AP"), ("texto AFP", "AFP", None),
])
def test_detect_wire(spark, note, outlet, wire):
    assert value(spark, wires.detect_wire, note, outlet) == wire


def test_regions(spark):
    assert value(spark, regions.region_label, "europe") == "Europa"
    assert value(spark, regions.region_label, "luna") == "luna"
    texts = spark.createDataFrame([(4, 1), (4, 2), (0, 0)], "c int, r int").select(regions.empty_region_text(F.col("c"), F.col("r")).alias("t"))
    assert [r.t for r in texts.collect()] == ["Cobertura insuficiente hoy (1 de 4 medios respondieron)."] + [regions.EMPTY_REGION] * 2


def test_model_json(spark):
    raw = '```json\n[{"index":0,"is_international":true,"countries":["A"],"companies":[],"relation_type":"trade","confidence":0.5,"reason":"r"}]\n```'
    out = value(spark, lambda c: parse_model_json(c, CLASSIFICATION_SCHEMA), raw)
    assert out[0]["index"] == 0 and out[0]["countries"] == ["A"]
    assert value(spark, lambda c: parse_model_json(c, CLASSIFICATION_SCHEMA), "no puedo") is None
    assert value(spark, lambda c: parse_model_json(c, CLASSIFICATION_SCHEMA), "[]") == []
    assert value(spark, extract_json, "Va: [1, [2]] listo") == "[1, [2]]"
    assert value(spark, lambda c: extract_json(c, "object"), 'x {"a":{}} y') == '{"a":{}}'
    assert value(spark, error_class, '{"error": "Check your plan and billing"}') == "hard_quota"
    assert value(spark, error_class, "Provider returned error") == "transient"
    assert value(spark, error_class, "bad key") == "other"
