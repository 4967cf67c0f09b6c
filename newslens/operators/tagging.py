"""Dictionary tagging, the keyword prefilter and the rule classifier.

Both taggers read a text once however many terms there are (`functions.automaton`). A short list is cheaper as generated code, and gives the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from newslens.functions.automaton import finder
from newslens.functions.binding import bind
from newslens.functions.text import lower_simple
from newslens.session import staged

Gazetteer = dict[str, list[str]]

KINDS = ("countries", "companies", "keywords")
#: Up to so many terms, one search for each is cheaper than sending the text to an automaton.
FEW_TERMS = 32
#: Bytes of terms in one automaton. A dictionary is measured first and cut into as many shards as it needs.
SHARD_BYTES = 1 << 25
#: Passes over the texts until shards are full; smaller shards than these passes need would make the work grow with texts times terms.
MOST_PASSES = 8


def matched(lowered: Column, terms: list[str]) -> Column:
    """Terms of a short list that occur in lower-cased text, in list order. Stays in generated code."""
    hits = [F.when(F.contains(lowered, lower_simple(F.lit(t))), F.lit(t)) for t in terms]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def matched_by_automaton(h: DataFrame, lowered: Column, gazetteer: Gazetteer) -> Column:
    """A struct with the terms of each kind that occur in lower-cased text, in list order."""
    listed = [(k, t) for k in KINDS for t in gazetteer.get(k, [])]
    size = sum(len(t.encode()) for _, t in listed)
    if size > SHARD_BYTES:
        raise ValueError(f"{size} bytes of terms: use gazetteer_join, which cuts a dictionary into shards")
    small = h.sparkSession.createDataFrame([(t,) for _, t in listed], "t string").select(lower_simple(F.col("t"))).collect()
    needles = h.sparkSession.sparkContext.broadcast(tuple(r[0] for r in small))
    kinds = StructType([StructField(k, ArrayType(StringType())) for k in KINDS])

    def find(texts: pd.Series) -> pd.DataFrame:
        seek = finder(needles.value).find
        found = [sorted(seek(t)) for t in texts]
        always = [i for i, n in enumerate(needles.value) if not n]  # the empty term is in every text
        return pd.DataFrame({k: [[listed[i][1] for i in sorted([*f, *always]) if listed[i][0] == k] if t is not None else [] for t, f in zip(texts, found, strict=True)] for k in KINDS})

    return F.pandas_udf(find, kinds)(lowered)


def prefilter(h: DataFrame, gazetteer: Gazetteer, text: Column | None = None, few: int = FEW_TERMS) -> DataFrame:
    """Adds matched_countries/companies/keywords and `passed`: a company, a keyword or two countries."""
    source = F.concat_ws(" ", "title", "snippet") if text is None else text
    lowered = bind(h, {"_lowered": lower_simple(source)})
    if sum(len(gazetteer.get(k, [])) for k in KINDS) <= few:
        tagged = bind(lowered, {f"matched_{k}": matched(F.col("_lowered"), gazetteer.get(k, [])) for k in KINDS})
    else:
        hits = bind(lowered, {"_hits": matched_by_automaton(h, F.col("_lowered"), gazetteer)})
        tagged = hits.select("*", *[F.col(f"_hits.{k}").alias(f"matched_{k}") for k in KINDS]).drop("_hits")
    passed = (
        (F.size("matched_companies") > 0) | (F.size("matched_keywords") > 0) | (F.size("matched_countries") >= 2)
    )
    return tagged.withColumn("passed", passed).drop("_lowered")


def prefilter_switch(h: DataFrame, enabled: bool) -> DataFrame:
    """Rows that go on to the classifier; with the prefilter off that is all of them."""
    return h.where("passed") if enabled else h


def gazetteer_join(notes: DataFrame, dictionary: DataFrame, key: str, text: Column, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, kind, term) for every dictionary term that occurs in a text.

    The dictionary (kind, term) is written out and measured. Each shard of it, by a hash of the lower-cased term, goes to the executors as a
    broadcast of about `shard_bytes`, and every text is read once for each shard; texts are not shuffled. A dictionary of more than MOST_PASSES
    such shards gets larger ones, up to SHARD_BYTES, so that the passes do not grow with it before. A dictionary that fits one
    shard, as any list kept by hand does, costs one pass. Null and empty terms are in no text, null texts hold none; a repeated dictionary row
    repeats its rows.
    """
    needles = staged(dictionary.select("kind", "term", lower_simple(F.col("term")).alias("needle")).where(F.col("needle") != ""))
    size = needles.agg(F.sum(F.octet_length("needle") + F.octet_length("term"))).first()[0] or 0
    held = max(shard_bytes, min(SHARD_BYTES, -(-size // MOST_PASSES)))
    shards = max(1, -(-size // held))
    texts = notes.select(key, lower_simple(text).alias("_text"))
    if shards > 1:
        texts = staged(texts)
    schema = StructType([*[f for f in texts.schema.fields if f.name == key], StructField("kind", StringType()), StructField("term", StringType())])
    found = None
    for i in range(shards):
        shard = needles.where(F.pmod(F.xxhash64("needle"), F.lit(shards)) == i)
        part = texts.mapInArrow(_hits(shard, key), schema)
        found = part if found is None else found.unionByName(part)
    return found


def _hits(shard: DataFrame, key: str):
    rows = shard.collect()
    terms = shard.sparkSession.sparkContext.broadcast((tuple(r.needle for r in rows), [r.kind for r in rows], [r.term for r in rows]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needles, kinds, names = terms.value
        seek = finder(needles).find
        for batch in batches:
            at, hit = [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                found = seek(text)
                at += [i] * len(found)
                hit += found
            columns = [batch.column(key).take(pa.array(at, pa.int32())), pa.array([kinds[j] for j in hit], pa.string()), pa.array([names[j] for j in hit], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "kind", "term"])

    return find


def rule_classify(h: DataFrame, relations: list[tuple[str, str]]) -> DataFrame:
    """Deterministic scorer over prefilter matches: relation type, confidence and the international flag.

    `relations` lists (keyword, relation type), first match wins; a company without one means supply_chain.
    """
    relation = F.coalesce(
        *[F.when(F.array_contains("matched_keywords", k), F.lit(r)) for k, r in relations],
        F.when(F.size("matched_companies") > 0, F.lit("supply_chain")),
        F.lit("none"),
    )
    points = (
        F.size("matched_countries") + F.size("matched_companies") * 2 + F.size("matched_keywords") * 2
    )
    confidence = F.least(F.lit(10), points + 4).cast("double") / F.lit(10.0)
    return h.withColumns({"relation_type": relation, "confidence": confidence}).withColumn(
        "is_international", F.col("passed") & (F.col("relation_type") != "none")
    )


def accepted(h: DataFrame) -> DataFrame:
    return h.where("is_international")
