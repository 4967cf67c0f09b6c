"""Streaming reads and runs to the end of what has landed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newslens.session import run_dir


def landed(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as they land. `files_per_batch` bounds a micro-batch, and with it the rows of one key in a batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Appends everything available to a table in the shared folder and reads it back."""
    spark = stream.sparkSession
    path = run_dir(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def drain_totals(stream: DataFrame, name: str) -> DataFrame:
    """Final rows of a running aggregate, such as counts per day: each micro-batch writes the whole result as a table, and the last one is read."""
    spark = stream.sparkSession
    path = run_dir(spark, name)
    written: list[str] = []

    def keep(totals: DataFrame, batch: int) -> None:
        totals.write.mode("overwrite").parquet(f"{path}/totals-{batch}")
        written.append(f"{path}/totals-{batch}")

    query = (
        stream.writeStream.foreachBatch(keep).outputMode("complete")
        .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(written[-1]) if written else spark.createDataFrame([], stream.schema)
