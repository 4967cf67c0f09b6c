"""Published editions: partitioned sink, file scan, and the join with their sidecar tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.schemas import OUTLET_SUMMARY

_DATED = r"^(\d{4}-\d{2}-\d{2})\.md$"


def write_editions(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Writes one partition per edition; only the editions in `df` are replaced."""
    (
        df.write.partitionBy("edition_date").mode("overwrite").option("partitionOverwriteMode", "dynamic").format(fmt).save(path)
    )


def read_editions(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Editions as written; a filter on edition_date reads only its partitions."""
    return spark.read.schema(schema).format(fmt).load(path)


def edition_dates(files: DataFrame) -> DataFrame:
    """Edition dates from file names `YYYY-MM-DD.md`, newest first; other files are ignored."""
    dated = F.regexp_extract("file_name", _DATED, 1)
    return (
        files.where(F.col("file_name").rlike(_DATED)).select(F.to_date(dated).alias("edition_date")).distinct()
        .orderBy(F.desc("edition_date"))
    )


def read_edition_files(spark: SparkSession, folder: str) -> DataFrame:
    """(edition_date, markdown) from a folder of dated Markdown files."""
    files = spark.read.text(f"{folder}/*.md", wholetext=True).select("value", F.col("_metadata.file_name").alias("file_name"))
    return files.where(F.col("file_name").rlike(_DATED)).select(
        F.to_date(F.regexp_extract("file_name", _DATED, 1)).alias("edition_date"), F.col("value").alias("markdown")
    )


def read_outlet_files(spark: SparkSession, folder: str) -> DataFrame:
    """(edition_date, sources) from the dated outlet lists beside the reports."""
    files = spark.read.text(f"{folder}/*.sources.json", wholetext=True).select("value", F.col("_metadata.file_name").alias("file_name"))
    return files.select(
        F.to_date(F.regexp_extract("file_name", r"^(\d{4}-\d{2}-\d{2})\.", 1)).alias("edition_date"),
        F.from_json("value", OUTLET_SUMMARY).alias("sources"),
    )


def latest_edition(editions: DataFrame) -> DataFrame:
    return editions.orderBy(F.desc("edition_date")).limit(1)


def edition_join(editions: DataFrame, outlet_lists: DataFrame, provenance: DataFrame) -> DataFrame:
    """Edition with its outlet list and run record; either may be missing."""
    return (
        editions.join(outlet_lists, "edition_date", "left").join(provenance, "edition_date", "left")
        .withColumn("source_count", F.greatest(F.coalesce(F.size("sources"), F.lit(0)), F.lit(0)))
    )
