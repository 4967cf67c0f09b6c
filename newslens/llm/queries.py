"""The registered queries of the operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.llm import chats, fingerprints, jaccard, leaks, lines, packing, phrases, prefixes, pseudonyms, repair, secrets, toxicity, whitening
from newslens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    split = lines.lines_of(F.col("text"))
    kept = lines.dedup_lines(docs.withColumn("n_lines", F.size(split).cast("long")), removed="n_removed")
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE["op3_line_dedup"] = lines.SQL


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.digests(table(spark, sf_dir, "documents"))


ORACLE["op10_repeated_phrases"] = phrases.SQL


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=90)


ORACLE["op4_jaccard_join"] = jaccard.SQL


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scans(table(spark, sf_dir, "documents"))


#: The key of the registered query only; a real run brings its own.
DEMO_KEY = "key of the registered query"


@query
def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymize(docs, DEMO_KEY, {k: f"n_{k}" for k in pseudonyms.KINDS})


@query
def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.preference_report(table(spark, sf_dir, "conversations"))


ORACLE["op7_preferences"] = chats.SQL


@query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.count_report(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(table(spark, sf_dir, "conversations"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
