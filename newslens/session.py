"""Session helpers: local session for tests and benches, shared work folder, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session; on a cluster the session comes from spark-submit instead."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("newslens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("NEWSLENS_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as `spark.checkpoint.dir` names it; a temporary one only for a local master."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="newslens-"))
    return sc.getCheckpointDir()


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one for a table or stream of this run."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder once and reads them back, by column.

    What follows neither recomputes them nor depends on the executors that made them, and plans with their real size.
    """
    path = run_dir(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: An input of fewer splits than this many for each core may hold all its rows in some of them.
SPLITS_PER_CORE = 4


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deals the rows of an input with few splits out over all cores before heavy work on them; one with many splits stays as it is.

    A file with a single row group is read by a single task however many splits it has, so a small number of splits says nothing of the rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(SPLITS_PER_CORE * cores, key) if df.rdd.getNumPartitions() < SPLITS_PER_CORE * cores else df
