"""Shared pieces: document keys that survive repeated ids and nulls, and bounded blocks of text inside a task."""

from __future__ import annotations

import gc
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.session import run_dir, staged

#: Stands for a null id; its negative is a number too.
NO_ID = -(2**63) + 1
BLOCK_CHARS = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def document(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column, Column]:
    """What stands for a document: its id (null: the smallest number), a checksum that tells texts of one id apart, and its text (null: empty).

    Rows that agree in both id and text are one document.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.crc32(body.cast("binary")).alias("part"), body.alias("text")


def documents(docs: DataFrame) -> DataFrame:
    """Only (doc, part, text), so that no other column of the input can clash with those of an operator."""
    return docs.select(*document())


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names that `docs` does not have."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def with_result(docs: DataFrame, result: DataFrame, **columns: str) -> DataFrame:
    """Left join of `docs` with a result of one row per (doc, part); `columns` maps result columns to new names."""
    doc, part = fresh(docs, "doc", "part")
    key, check, _ = document()
    right = result.select(F.col("doc").alias(f"{doc}_r"), F.col("part").alias(f"{part}_r"), *[F.col(c).alias(n) for c, n in columns.items()])
    left = docs.withColumns({doc: key, part: check})
    return left.join(right, (F.col(doc) == F.col(f"{doc}_r")) & (F.col(part) == F.col(f"{part}_r")), "left").drop(doc, part, f"{doc}_r", f"{part}_r")


def settled(df: DataFrame) -> DataFrame:
    """`staged`, after which Spark may drop the shuffle files that led to the table: its cleaner acts when the driver collects garbage."""
    out = staged(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


class Scratch:
    """Written tables of one operator; each can go as soon as all that is read from it has been written out itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Writes a table and reads it back; then Spark may drop the shuffle files that led to it, as after `settled`."""
        path = self.paths[name] = run_dir(self.spark, name)
        df.write.parquet(path)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables. Nothing that is still to be computed may read them."""
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def public_id() -> Column:
    return F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id")


def blocks(texts: list[str], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Slices of consecutive texts with at most `limit` characters together, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if len(texts) > start:
        yield start, len(texts)
