"""Labelled examples for classifier evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.schemas import EXAMPLE


def parse_examples(lines: DataFrame) -> DataFrame:
    """Examples from JSON text in `value`; blank lines are skipped, a broken line fails the read."""
    kept = lines.where(F.trim("value") != "")
    return kept.select(F.from_json("value", EXAMPLE, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    return parse_examples(spark.read.text(path))
