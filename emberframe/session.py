"""What every part of the library needs from a Spark session: the shared folder, cut lineage, partition counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_held: set[str] = set()  # folders of applications that have been made


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests, local mode)."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named.rstrip("/")
    held = context.getCheckpointDir()
    if held is None:
        if not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir isn't set: on a cluster it must name a folder that all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="emberframe-")
        context.setCheckpointDir(held)
    return held.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application below the shared one. It goes when the driver ends."""
    path = f"{shared_dir(spark)}/emberframe-{spark.sparkContext.applicationId}"
    if path not in _held:
        _held.add(path)
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
    return path


def release(spark: SparkSession) -> None:
    """Deletes what this application has stored so far. Results that haven't been written yet can't be read any more."""
    path = run_dir(spark)
    _held.discard(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new path of its own below the application's folder. Nothing is created yet."""
    return f"{run_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """df computed once as a Parquet table in the shared folder, so that lost executors cost no recomputation of its lineage. Its shuffle
    files go as soon as it is written.
    """
    spark, path = df.sparkSession, work_dir(df.sparkSession, purpose)
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut. A table that is read again has the size of its files; a checkpoint keeps the estimate of the plan that
    made it, which multiplies with every join of a loop until planning takes longer than the work.
    """
    return stored(df, "cut")


def shuffle_partitions(spark: SparkSession) -> int:
    """The number of partitions that the session gives a shuffle; a cluster sets it to the size of its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables below sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
