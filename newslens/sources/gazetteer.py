"""Dictionary of countries, companies and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.schemas import GAZETTEER, GAZETTEER_ROW
from newslens.sources.yaml_files import gazetteer_rows, is_yaml, parse_text


def gazetteer_terms(lists: DataFrame) -> DataFrame:
    """(kind, term) rows from one column of terms per kind."""
    kinds = F.create_map(*[x for k in ("countries", "companies", "keywords") for x in (F.lit(k), F.coalesce(k, F.array().cast("array<string>")))])
    return lists.select(F.explode(kinds).alias("kind", "_terms")).select("kind", F.explode("_terms").alias("term"))


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(kind, term) rows from a YAML or JSON file, by file ending, with the three lists. Entries of a YAML file that are no term are left out."""
    if is_yaml(path):
        entries = parse_text(spark.read.text(path, wholetext=True), gazetteer_rows, GAZETTEER_ROW)
        return entries.where("problem is null").select("kind", "term")
    return gazetteer_terms(spark.read.schema(GAZETTEER).option("multiLine", True).json(path))
