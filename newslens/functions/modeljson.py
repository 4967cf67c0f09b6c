"""Reading model responses: JSON inside free text, typed parsing, error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newslens.functions.text import strip

CLASSIFICATION_SCHEMA = (
    "array<struct<index:int,is_international:boolean,countries:array<string>,companies:array<string>,"
    "relation_type:string,confidence:double,reason:string>>"
)
VERDICT_SCHEMA = "array<struct<id:int,verdict:string,problem:string>>"
GROUP_SCHEMA = "array<struct<event:string,items:array<int>>>"

# Phrases that mark a passing failure, and a used-up plan quota.
TRANSIENT_PHRASES = ["provider returned error", "overloaded", "try again", "timeout", "internal server error"]
HARD_QUOTA_PHRASE = "check your plan and billing"


def _unfenced(c: Column) -> Column:
    t = F.regexp_replace(strip(c), r"^```(?:json)?", "")
    return strip(F.regexp_replace(t, r"```$", ""))


def extract_json(c: Column, kind: str = "array") -> Column:
    """The outermost JSON array (or object) of a response; the unfenced text when there is none."""
    pattern = r"(?s)\[.*\]" if kind == "array" else r"(?s)\{.*\}"
    t = _unfenced(c)
    return F.coalesce(F.nullif(F.regexp_extract(t, pattern, 0), F.lit("")), t)


def parse_model_json(c: Column, schema: str) -> Column:
    """Typed items of a response; NULL when it is not the JSON that was asked for."""
    text = extract_json(c)
    return F.when(text.rlike(r"(?s)^\[.*\]$"), F.from_json(text, schema, {"mode": "PERMISSIVE"}))


def error_class(body: Column) -> Column:
    """Kind of failure a provider reported: hard_quota, transient or other."""
    low = F.lower(body)
    transient = F.lit(False)
    for phrase in TRANSIENT_PHRASES:
        transient = transient | F.contains(low, F.lit(phrase))
    return (
        F.when(F.contains(low, F.lit(HARD_QUOTA_PHRASE)), F.lit("hard_quota"))
        .when(transient, F.lit("transient"))
        .otherwise(F.lit("other"))
    )
