"""Format-preserving pseudonyms for private numbers, dates and addresses, in DataFrame functions only.

A value is read as a row of digits of mixed radix (decimal digits, letters, octets, days in blocks of 65,536, the valid areas, groups and
serials of a social security number). A keyed Feistel network permutes that row: its halves take turns at being shifted by a hash of the
other half, the round, the kind and the length. So every value goes to a value of the same kind, format and validity, equal values stay
equal in all documents, different ones stay different, and the key holder can turn it back. Check digits are computed anew.

Kinds: payment cards (13 to 19 digits with a valid check digit), international phone numbers (country code kept), IPv4 addresses, e-mail
addresses (domain kept; names of 256 characters and hosts of 127 labels at most), dates (year-month-day; day, month, year with '/' or '.'; month/day/year for days 13 to 28), social security numbers,
and bank account numbers with a valid checksum (country kept). Numbers and dates that fail their check stay as they are.

Null texts stay null, empty ones empty; repeated rows get equal results; other columns are kept as they are. Matches are handled inside
their row: nothing is shuffled. Matching takes time in proportion to the text, also where it has no space or is a host without an end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.llm.common import fresh

ROUNDS = 10
KINDS = ("email", "iban", "ssn", "date", "ip", "phone", "card")
PATTERNS = {
    # A run of name characters is tried once, as a whole; labels and hosts have the lengths that the domain name system allows.
    "email": r"(?<![A-Za-z0-9._%+-])(?=[._%+-]*+[A-Za-z0-9])[A-Za-z0-9._%+-]{1,256}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){0,126}\.[A-Za-z]{2,63}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{PATTERNS[k]})" for k in KINDS)
# The country codes of telephone numbers. None starts another; all that are not listed have three digits.
COUNTRY_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
DIGITS = "array<struct<v:bigint,m:bigint>>"
STATE = f"struct<a:{DIGITS},b:{DIGITS}>"


def digit(value: Column, modulus: Column | int) -> Column:
    return F.struct(value.cast("bigint").alias("v"), (F.lit(modulus) if isinstance(modulus, int) else modulus).cast("bigint").alias("m"))


def row(*digits: Column) -> Column:
    return F.array(*digits).cast(DIGITS)


def feistel(digits: Column, kind: str, key: str, back: bool = False) -> Column:
    """The permuted digits. `back` undoes it."""
    half = F.ceil(F.size(digits) / 2).cast("int")
    start = F.struct(F.slice(digits, 1, half).alias("a"), F.slice(digits, half + 1, F.size(digits) - half).alias("b")).cast(STATE)

    def shifted(x: Column, other: Column, turn: Column) -> Column:
        said = F.array_join(F.transform(other, lambda d: d.v.cast("string")), ",")
        hashed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.size(x).cast("string"), turn.cast("string"), said).cast("binary"), 512)

        def step(d: Column, i: Column) -> Column:
            word = F.conv(F.substring(hashed, (i % 16) * 8 + 1, F.lit(8)), 16, 10).cast("bigint")
            return digit(F.pmod(d.v - word if back else d.v + word, d.m), d.m)

        return F.transform(x, step).cast(DIGITS)

    def round_of(state: Column, turn: Column) -> Column:
        left = F.struct(shifted(state.a, state.b, turn).alias("a"), state.b.alias("b")).cast(STATE)
        right = F.struct(state.a.alias("a"), shifted(state.b, state.a, turn).alias("b")).cast(STATE)
        return F.when(turn % 2 == 0, left).otherwise(right)

    turns = [F.lit(i) for i in range(ROUNDS)]
    end = F.aggregate(F.array(*(reversed(turns) if back else turns)), start, round_of)
    return F.concat(end.a, end.b)


def characters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def by_character(value: Column, active: Column, kind: str, key: str, back: bool) -> Column:
    """Permutes the letters and digits of a value where `active` (an array of booleans) is true; all else stays in its place.

    Signs between the digits don't matter: one number written in two ways goes to one number.
    """

    def read(c: Column, on: Column) -> Column:
        number = F.when(on & c.rlike("^[0-9]$"), digit(F.ascii(c) - 48, 10)).when(on & c.rlike("^[a-z]$"), digit(F.ascii(c) - 97, 26))
        return F.struct(c.alias("c"), number.when(on & c.rlike("^[A-Z]$"), digit(F.ascii(c) - 65, 26)).alias("d"))

    def write(x: Column, d: Column) -> Column:
        base = F.when(d.m == 10, 48).when(x.c.rlike("^[a-z]$"), 97).otherwise(65)
        return F.struct(x.i.alias("i"), F.chr(base + d.v).alias("c"))

    marked = F.transform(F.zip_with(characters(value), active, read), lambda x, i: F.struct(i.alias("i"), x.c.alias("c"), x.d.alias("d")))
    moving, still = F.filter(marked, lambda x: x.d.isNotNull()), F.filter(marked, lambda x: x.d.isNull())
    moved = feistel(F.transform(moving, lambda x: x.d).cast(DIGITS), kind, key, back)
    placed = F.concat(F.zip_with(moving, moved, write), F.transform(still, lambda x: F.struct(x.i.alias("i"), x.c.alias("c"))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x.c), "")


def positions(value: Column, test) -> Column:  # noqa: ANN001
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))), test)


def check_digit(digits: Column) -> Column:
    """The digit that makes a string of digits valid for payment cards when it is put behind them."""
    places = F.reverse(characters(digits))

    def weight(c: Column, i: Column) -> Column:
        n = c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return n - F.when(n > 9, 9).otherwise(0)

    total = F.aggregate(F.transform(places, weight), F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def remainder_97(account: Column) -> Column:
    """The account number, its first four characters put last and letters read as 10 to 35, modulo 97."""
    compact = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))

    def feed(rest: Column, c: Column) -> Column:
        n = F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (rest * F.when(n > 9, 100).otherwise(10) + n) % 97

    return F.aggregate(characters(turned), F.lit(0), feed)


def card(value: Column, key: str, back: bool) -> Column:
    digits = only_digits(value)
    head = F.substr(digits, F.lit(1), F.length(digits) - 1)
    size = F.length(value)
    moved = by_character(value, positions(value, lambda i: i < size), "card", key, back)
    plain = only_digits(moved)
    fixed = F.concat(F.substr(moved, F.lit(1), size - 1), check_digit(F.substr(plain, F.lit(1), F.length(plain) - 1)))
    return F.when(F.right(digits, F.lit(1)) == check_digit(head), fixed)


def phone(value: Column, key: str, back: bool) -> Column:
    """The country code is kept, whatever signs stand behind or in it, so that one number in several notations goes to one number."""
    country = F.length(F.regexp_extract(only_digits(value), f"^(?:{COUNTRY_CODES})", 0))
    return by_character(value, positions(value, lambda i: F.length(only_digits(F.left(value, i))) > country), "phone", key, back)


def email(value: Column, key: str, back: bool) -> Column:
    at = F.instr(value, "@")
    return by_character(value, positions(value, lambda i: i < at), "email", key, back)


def iban(value: Column, key: str, back: bool) -> Column:
    moved = by_character(value, positions(value, lambda i: i > 4), "iban", key, back)
    open_check = F.concat(F.substr(moved, F.lit(1), F.lit(2)), F.lit("00"), F.substr(moved, F.lit(5)))
    check = F.lpad((98 - remainder_97(open_check)).cast("string"), 2, "0")
    return F.when(remainder_97(value) == 1, F.concat(F.substr(moved, F.lit(1), F.lit(2)), check, F.substr(moved, F.lit(5))))


def ip(value: Column, key: str, back: bool) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda x: x.try_cast("bigint"))
    moved = feistel(F.transform(octets, lambda x: digit(x, 256)).cast(DIGITS), "ip", key, back)
    return F.when(F.forall(octets, lambda x: x < 256), F.array_join(F.transform(moved, lambda d: d.v.cast("string")), "."))


def ssn(value: Column, key: str, back: bool) -> Column:
    area, group, serial = (F.get(F.split(value, "-"), i).try_cast("int") for i in range(3))
    index = area - 1 - F.when(area > 666, 1).otherwise(0)
    moved = feistel(row(digit(index, 898), digit(group - 1, 99), digit(serial - 1, 9999)), "ssn", key, back)
    new = moved[0].v + 1
    new = new + F.when(new >= 666, 1).otherwise(0)
    parts = [F.lpad(x.cast("string"), n, "0") for x, n in ((new, 3), (moved[1].v + 1, 2), (moved[2].v + 1, 4))]
    return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), F.concat_ws("-", *parts))


#: Days are permuted inside blocks of 65,536; one block holds the days from here on, others follow on both sides.
FIRST_DAY = "1921-01-01"
DAYS = 1 << 16


def date(value: Column, key: str, back: bool) -> Column:
    out = None
    for sign, shape in (("-", "yyyy-MM-dd"), ("/", "dd/MM/yyyy"), (".", "dd.MM.yyyy")):
        day = F.try_to_timestamp(value, F.lit(shape)).cast("date")
        since = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("bigint")
        block, inside = F.floor(since / DAYS), F.pmod(since, F.lit(DAYS))
        moved = feistel(row(digit(F.shiftright(inside, 8), 256), digit(F.pmod(inside, F.lit(256)), 256)), "date", key, back)
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), (block * DAYS + moved[0].v * 256 + moved[1].v).cast("int"))
        # Years 1024 to 9000 lie in whole blocks of four-digit years.
        inside_years = (F.year(day) >= 1100) & (F.year(day) <= 9000)
        case = F.when(F.contains(value, F.lit(sign)) & inside_years, F.date_format(new, shape))
        out = case if out is None else F.coalesce(out, case)
    month, number, year = (F.try_element_at(F.split(value, "/"), F.lit(i)).try_cast("int") for i in (1, 2, 3))
    moved = feistel(row(digit(month - 1, 12), digit(number - 13, 16), digit(year % 100, 100)), "us-date", key, back)
    parts = [F.lpad(x.cast("string"), n, "0") for x, n in ((moved[0].v + 1, 2), (moved[1].v + 13, 2), (year - year % 100 + moved[2].v, 4))]
    return F.coalesce(out, F.when(month.between(1, 12) & number.between(13, 28), F.concat_ws("/", *parts)))


HANDLERS = {"email": email, "iban": iban, "ssn": ssn, "date": date, "ip": ip, "phone": phone, "card": card}


def pseudonym(value: Column, key: str, back: bool = False) -> Column:
    """(kind, new value) of a matched string: the first kind that it has the shape of and whose check it passes; nulls if none."""
    cases = []
    for k in KINDS:
        shape = value.rlike(f"^(?:{PATTERNS[k]})$")
        new = F.when(shape, HANDLERS[k](value, key, back))
        cases.append(F.when(new.isNotNull(), F.struct(F.lit(k).alias("kind"), new.alias("new"))))
    return F.coalesce(*cases)


def of_kind(kind: str):  # noqa: ANN201
    return lambda x: F.when(x.kind == kind, F.lit(1))


def pseudonymize(docs: DataFrame, key: str, counts: dict[str, str] | None = None, back: bool = False) -> DataFrame:
    """`docs` with the private values in `text` replaced. `counts` maps kinds to names of columns for the number of replaced values."""
    found, new, gaps = fresh(docs, "found", "new", "gaps")
    out = docs.withColumn(found, F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    some = F.size(F.coalesce(F.col(found), F.array().cast("array<string>"))) > 0
    out = out.withColumn(new, F.when(some, F.transform(found, lambda m: pseudonym(m, key, back))))
    out = out.withColumn(gaps, F.when(some, F.split("text", ANY, -1)))

    def piece(gap: Column, i: Column) -> Column:
        return F.concat(gap, F.coalesce(F.get(F.col(new), i).new, F.get(F.col(found), i), F.lit("")))

    for kind, name in (counts or {}).items():
        n = F.size(F.array_compact(F.transform(new, of_kind(kind))))
        out = out.withColumn(name, F.coalesce(F.when(some, n), F.lit(0)).cast("long"))
    return out.withColumn("text", F.when(some, F.array_join(F.transform(gaps, piece), "")).otherwise(F.col("text"))).drop(found, new, gaps)


