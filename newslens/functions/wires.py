"""Wire-agency credits and the voice behind a note."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_word(pattern: str) -> str:
    """`pattern` as a whole word, where only ASCII letters, digits and underscore are word characters."""
    return rf"(?<![A-Za-z0-9_]){pattern}(?![A-Za-z0-9_])"


# Agencies and the credits that name them, in order of precedence.
WIRE_AGENCIES: list[tuple[str, str]] = [
    ("Reuters", ascii_word("Reuters")),
    ("AFP", ascii_word("AFP") + "|Agence France-Presse"),
    ("AP", r"\(AP\)|(?<![A-Za-z0-9_])AP\s[—–-]\s|Associated Press"),
    ("EFE", ascii_word("EFE")),
    ("Europa Press", "Europa Press"),
    ("ANSA", ascii_word("ANSA")),
    ("dpa", ascii_word("dpa") + "|" + ascii_word("DPA")),
    ("Bloomberg", ascii_word("Bloomberg")),
    ("Xinhua", ascii_word("Xinhua")),
    ("TASS", ascii_word("TASS")),
    ("RIA Novosti", "RIA Novosti"),
    ("Anadolu", ascii_word("Anadolu")),
]


def detect_wire(text: Column, outlet_name: Column, wires: list[tuple[str, str]] = WIRE_AGENCIES) -> Column:
    """First agency credited in `text` that is not the outlet itself; NULL when there is none."""
    return F.coalesce(
        *[F.when(text.rlike(p) & ~outlet_name.rlike(p), F.lit(name)) for name, p in wires], F.lit(None).cast("string")
    )


def voice_key(wire: Column, ownership: Column, country: Column, source_id: Column) -> Column:
    """Independent voice: the agency for wire copy, the state for state media, else the outlet."""
    return (
        F.when(wire.isNotNull(), F.concat(F.lit("cable:"), wire))
        .when(ownership == "estatal", F.concat(F.lit("estatal:"), country))
        .otherwise(F.concat(F.lit("medio:"), source_id))
    )


def source_kind(ownership: Column, note: Column) -> Column:
    """Ownership with its optional note in brackets."""
    kind = F.coalesce(F.nullif(ownership, F.lit("")), F.lit("sin clasificar"))
    return F.when(F.coalesce(note, F.lit("")) == "", kind).otherwise(F.concat(kind, F.lit(" ("), note, F.lit(")")))
