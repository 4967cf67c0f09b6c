"""Text, link, date and identity columns. Everything here is a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Length limits of feed text, in code points.
MAX_TITLE = 300
MAX_SNIPPET = 1000
WORDS_PER_MINUTE = 200

# Spanish calendar names, Sunday first and January first.
WEEKDAYS_ES = ["domingo", "lunes", "martes", "miércoles", "jueves", "viernes", "sábado"]
MONTHS_ES = [
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
]

NEWS_HEADING = "## Noticias utilizadas"

_BLANK = r"[\p{Z}\p{Cc}]+"
_WORD = r"[^\s\p{Z}]*[\p{L}\p{N}][^\s\p{Z}]*"
_RESOLVED = r"\[\[\d+\]\]\(<[^>]*>\)"
_ANY_LINK = r"\[([^\]]*)\]\([^)]*\)"
_MARKUP = r"[#*_>`|-]"


def array_of(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def strip(c: Column) -> Column:
    """Trim all white space, line ends included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of space and control characters become one space; ends trimmed."""
    return F.trim(F.regexp_replace(c, _BLANK, " "))


def clean_text(c: Column, limit: int) -> Column:
    """`collapse`, then cut to `limit` code points, the last one an ellipsis."""
    t = collapse(c)
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.left(t, F.lit(limit - 1))), F.lit("…"))).otherwise(t)


def truncate(c: Column, limit: int) -> Column:
    """First `limit` code points, with an ellipsis added when something was cut."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("…"))).otherwise(c)


def lower_simple(c: Column) -> Column:
    """Lower case with one code point for the dotted capital I, as a simple case mapping gives."""
    return F.lower(F.replace(c, F.lit("İ"), F.lit("i")))


def clean_link(c: Column) -> Column:
    """The trimmed link when it is absolute http(s) with a host, else the empty string."""
    t = strip(c)
    ok = t.rlike(r"(?i)^https?://[^/?#\s\p{Cc}]+[^\p{Cc}]*$")
    scheme = F.lower(F.regexp_extract(t, r"^([A-Za-z]+)://", 1))
    rest = F.replace(F.regexp_extract(t, r"(?s)^[A-Za-z]+(://.*)$", 1), F.lit(" "), F.lit("%20"))
    return F.when(ok, F.concat(scheme, rest)).otherwise(F.lit(""))


def host_of(c: Column) -> Column:
    """Host without port and without a leading `www.`; text that is no URL is returned as it is."""
    host = F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host == "", c).otherwise(F.regexp_replace(host, r"^www\.", ""))


def utc_ntz(c: Column) -> Column:
    """An instant as a zone-less UTC timestamp, whatever the session time zone is."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), epoch)


def epoch_us(c: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session time zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def parse_pubdate(c: Column) -> Column:
    """Publication date in the first layout that fits, as UTC; NULL when none does."""
    t = strip(c)
    bare = F.regexp_replace(t, r"^[A-Za-z]{3}, ", "")
    utc = F.concat(t, F.lit(" +0000"))
    micros = F.regexp_replace(t, r"(\.[0-9]{6})[0-9]+", "$1")
    # Accepted date layouts, in order of preference.
    attempts = [
        F.try_to_timestamp(bare, F.lit("dd MMM yyyy HH:mm:ss xx")),
        F.try_to_timestamp(bare, F.lit("dd MMM yyyy HH:mm:ss z")),
        F.try_to_timestamp(micros, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]XXX")),
        F.try_to_timestamp(utc, F.lit("yyyy-MM-dd xx")),
        F.try_to_timestamp(utc, F.lit("yyyy-MM-dd HH:mm:ss xx")),
    ]
    return utc_ntz(F.coalesce(*attempts))


def escape_link_text(c: Column) -> Column:
    """Link text on one line with its brackets escaped."""
    one_line = strip(F.regexp_replace(c, r"\s+", " "))
    return F.replace(F.replace(one_line, F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))


def reading_minutes(md: Column) -> Column:
    """Reading time of a report without its news list, citations and markup; at least one minute."""
    body = F.substring_index(md, "\n" + NEWS_HEADING, 1)
    text = F.regexp_replace(body, _RESOLVED, " ")
    text = F.regexp_replace(text, _ANY_LINK, "$1")
    text = F.regexp_replace(text, _MARKUP, " ")
    words = F.regexp_count(text, F.lit(_WORD))
    return F.greatest(F.lit(1), F.round(words / F.lit(float(WORDS_PER_MINUTE))).cast("int"))


def date_label_es(c: Column) -> Column:
    """`2026-09-23` -> `miércoles, 23 de septiembre de 2026`; other text is returned as it is."""
    valid = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c)
    d = F.try_to_date(valid, "yyyy-MM-dd")
    label = F.concat(
        F.get(array_of(WEEKDAYS_ES), F.dayofweek(d) - 1), F.lit(", "), F.day(d).cast("string"), F.lit(" de "),
        F.get(array_of(MONTHS_ES), F.month(d) - 1), F.lit(" de "), F.year(d).cast("string"),
    )
    return F.when(d.isNull(), c).otherwise(label)


def normalize_set(c: Column) -> Column:
    """Trimmed, lower-cased, distinct, sorted, without empty items."""
    items = F.transform(c, lambda x: lower_simple(strip(x)))
    return F.array_sort(F.array_distinct(F.filter(items, lambda x: x != "")))


def normalize_email(c: Column) -> Column:
    """Trimmed and lower-cased bare address of at most 254 bytes, else NULL (an approximation of RFC 5322)."""
    t = lower_simple(strip(c))
    atom = r"[\p{L}\p{N}!#$%&'*+/=?^_`{|}~-]+"
    bare = rf"^{atom}(\.{atom})*@[^\s@<>()\[\]\\,;:\"]+$"
    return F.when((F.octet_length(t) <= 254) & t.rlike(bare), t)


def client_key(forwarded_for: Column, peer: Column) -> Column:
    """Last forwarded address, which the proxy writes; without one the peer address without its port."""
    last = F.trim(F.element_at(F.split(forwarded_for, ","), -1))
    host = F.regexp_extract(peer, r"^\[?(.*?)\]?:\d+$", 1)
    return F.coalesce(F.nullif(last, F.lit("")), F.nullif(host, F.lit("")), peer)


def fingerprint(c: Column) -> Column:
    """SHA-256 of a prompt, as published with each edition."""
    return F.sha2(c, 256)
