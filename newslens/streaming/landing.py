"""Landing folders: a stream source that counts in files, and an ingest that says of every row what became of it.

`spark.readStream.format("landing")` reads Parquet files in the order in which they landed (time, then name). Its offset is the last file of a
micro-batch; Spark keeps offsets and commits in the query's checkpoint, so a restarted query goes on with the next file. A file that lands later
with an earlier name is read later. Names that start with a dot or an underscore are not there yet.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from newslens.operators.headlines import MAX_AGE_HOURS, MAX_PER_SOURCE, is_current
from newslens.sources.feeds import parse_feeds

#: Files that one task reads at most.
FILES_PER_TASK = 16

# What becomes of a row.
KEPT, STALE, LATE, DUPLICATE = "kept", "stale", "late", "duplicate"


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class LandingReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def _landed(self) -> list[tuple[int, str]]:
        from pyarrow import fs

        store, path = self._store()
        found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        return sorted((f.mtime_ns, f.path) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))

    def initialOffset(self) -> dict:
        return {"time": 0, "file": ""}

    def latestOffset(self) -> dict:
        landed = self._landed()
        return {"time": landed[-1][0], "file": landed[-1][1]} if landed else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        first, last = ((o["time"], o["file"]) for o in (start, end))
        new = [path for time, path in self._landed() if first < (time, path) <= last]
        return [Files(new[i : i + FILES_PER_TASK]) for i in range(0, len(new), FILES_PER_TASK)]

    def read(self, partition: Files) -> Iterator:
        from pyarrow import parquet

        store, _ = self._store()
        shape = to_arrow_schema(self.schema)
        for path in partition.paths:
            with parquet.ParquetFile(store.open_input_file(path)) as file:
                for batch in file.iter_batches(columns=shape.names):
                    yield batch.select(shape.names).cast(shape)

    def commit(self, end: dict) -> None:
        """Spark's commit log has it; files stay, so that another query can read them."""


class Landing(DataSource):
    """Rows of landed Parquet files; the schema is the reader's."""

    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self):
        raise ValueError("give a schema for the landing folder")

    def streamReader(self, schema: StructType) -> LandingReader:
        return LandingReader(self.options["path"], schema)


def landing(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    """The folder as a stream."""
    spark.dataSource.register(Landing)
    return spark.readStream.format("landing").schema(schema).load(folder)


class Ingest:
    """Headlines of a stream of payloads, each row with what became of it, in a table below `folder`.

    A row is stale by the age limit at `now`; late if its time lies further back than the age limit from the latest time of the batches before;
    a duplicate if its outlet and link (title where there is no link) were kept before, or come earlier in the batch; else kept. Nothing is
    left out, so `counts` add up to the rows parsed. A batch that is run again replaces what it wrote. Undated rows have the time of their fetch.
    """

    def __init__(self, folder: str, now: Column, max_items: int | None = MAX_PER_SOURCE, max_age_hours: int = MAX_AGE_HOURS):
        self.folder, self.now, self.max_items, self.hours = folder.rstrip("/"), now, max_items, max_age_hours

    ROWS = "source_id string, fetched_at timestamp_ntz, feed_pos int, title string, link string, snippet string, published_at timestamp_ntz, event_time timestamp_ntz, identity string, row bigint"

    def _table(self, spark: SparkSession, name: str, schema: str, before: int) -> DataFrame:
        """Rows of a table from the batches before a given one; none if nothing was written yet."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], f"{schema}, batch bigint")
        return spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.folder}/{name}").where(F.col("batch") < before)

    def batch(self, payloads: DataFrame, number: int) -> None:
        """One micro-batch, for `foreachBatch`."""
        spark = payloads.sparkSession
        parsed = parse_feeds(payloads, self.max_items, ("source_id", "fetched_at"))
        identity = F.when(F.col("link") == "", F.col("title")).otherwise(F.col("link"))
        timed = parsed.withColumns({"event_time": F.coalesce("published_at", "fetched_at"), "identity": identity, "row": F.monotonically_increasing_id()})
        path = f"{self.folder}/arrived/batch={number}"
        timed.write.mode("overwrite").parquet(path)
        rows = spark.read.schema(self.ROWS).parquet(path)
        times = self._table(spark, "arrived", self.ROWS, number).agg(F.max("event_time").alias("latest")).first()["latest"]
        oldest = F.lit(times).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(self.hours)} HOURS")
        late = F.coalesce(F.col("event_time") < oldest, F.lit(False))
        stale = ~is_current(self.now, self.hours)
        judged = rows.withColumn("outcome", F.when(stale, STALE).when(late, LATE))
        kept = self._table(spark, "headlines", f"{self.ROWS}, outcome string", number).where((F.col("outcome") == KEPT) & ((F.col("event_time") >= oldest) | oldest.isNull()))
        known = kept.groupBy(F.col("source_id").alias("_source"), F.col("identity").alias("_identity")).agg(F.lit(-1).cast("bigint").alias("_first"))
        new = judged.where("outcome is null").groupBy(F.col("source_id").alias("_source"), F.col("identity").alias("_identity")).agg(F.min("row").alias("_first"))
        first = known.unionByName(new).groupBy("_source", "_identity").agg(F.min("_first").alias("_first"))
        same = F.col("source_id").eqNullSafe(F.col("_source")) & F.col("identity").eqNullSafe(F.col("_identity"))
        outcome = F.coalesce("outcome", F.when(F.col("row") == F.col("_first"), KEPT).otherwise(DUPLICATE))
        told = judged.join(first, same, "left").withColumn("outcome", outcome).drop("_source", "_identity", "_first")
        told.write.mode("overwrite").parquet(f"{self.folder}/headlines/batch={number}")

    def run(self, payloads: DataFrame) -> None:
        """All that has landed; what a former run did is not done again."""
        stream = payloads.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.folder}/state")
        stream.trigger(availableNow=True).start().awaitTermination()

    def rows(self, spark: SparkSession) -> DataFrame:
        """Every row that came, with its outcome and batch."""
        return self._table(spark, "headlines", f"{self.ROWS}, outcome string", 2**62)

    def counts(self, spark: SparkSession) -> DataFrame:
        """Rows by outlet and outcome."""
        return self.rows(spark).groupBy("source_id", "outcome").agg(F.count("*").alias("rows"))
