"""The corpus pipeline: toxic documents go, repeated lines go, one document of each group of near copies stays, leaks go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and all rows its predecessor kept; all but the last return the columns of documents. Null and empty
texts pass the filters and are packed as an end id; see the operators for ties, repeated rows and other special cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.llm import jaccard, leaks, lines, packing, toxicity
from newslens.llm.common import table
from newslens.llm.queries import tokenizer_path
from newslens.session import run_dir


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, words=5, percent=80)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", toxic_stage), ("line_dedup", line_stage), ("jaccard_join", jaccard_stage), ("decontamination", leak_stage), ("packing", packing_stage)]

#: The tokenizer and the fitted scores have no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each stage keeps is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = run_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
