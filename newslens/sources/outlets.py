"""Outlet list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.schemas import OUTLET
from newslens.sources.yaml_files import is_yaml, outlet_rows, parse_text


def with_feed_flag(outlets: DataFrame) -> DataFrame:
    """`has_feed`: an address is given and is not marked as missing."""
    return outlets.withColumn("has_feed", ~F.coalesce("rss", F.lit("")).isin("", "NO_RSS"))


def outlet_entries(spark: SparkSession, path: str) -> DataFrame:
    """All entries of a YAML outlet list, the good ones and those with a `problem`."""
    schema = ", ".join(f"{n} string" for n in [*OUTLET.fieldNames(), "problem"])
    return parse_text(spark.read.text(path, wholetext=True), outlet_rows, schema)


def read_outlets(spark: SparkSession, path: str) -> DataFrame:
    """Outlets from YAML, JSON lines or parquet, by file ending, with the fixed outlet schema. Entries of a YAML file with a problem are left out."""
    if is_yaml(path):
        raw = outlet_entries(spark, path).where("problem is null").drop("problem")
    else:
        reader = spark.read.schema(OUTLET)
        raw = reader.parquet(path) if path.endswith(".parquet") else reader.json(path)
    return with_feed_flag(raw.withColumnRenamed("id", "source_id"))
