"""Row shapes of the tables a user brings."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, StringType, StructField, StructType


def _strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


OUTLET = _strings(
    "id", "name", "country", "region", "stance", "ownership", "ownership_note", "lang", "homepage", "rss"
)
EXAMPLE = StructType(
    _strings("id", "title", "snippet", "source", "country").fields
    + [StructField("expected", BooleanType()), StructField("note", StringType())]
)
GAZETTEER = "countries array<string>, companies array<string>, keywords array<string>"
GAZETTEER_ROW = "kind string, term string, problem string"
OUTLET_SUMMARY = "array<struct<name:string,country:string>>"
