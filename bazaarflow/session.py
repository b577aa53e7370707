"""Session helpers: settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks.

    On a cluster the session comes from the submitting environment; only SETTINGS matter there.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bazaarflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: what the session names in ``spark.checkpoint.dir``.

    A temporary folder is set only where nothing is named and the master is local (tests).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/bazaarflow/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str, tasks_per_core: int = 4) -> DataFrame:
    """The rows dealt evenly over several tasks for each core, by a key with many values.

    For narrow tables whose rows cost much more time than bytes: one small file is one task otherwise, whatever the number of
    its rows. Tables that already lie in that many partitions stay as they are.
    """
    tasks = tasks_per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks, key)


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes the table to the shared folder and reads it back.

    It is computed once however often it is used, a lost executor does not restart what came before, and
    Spark knows its true size: small tables are broadcast, larger ones are joined by a shuffle.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
