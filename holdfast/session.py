"""Places on shared storage that survive the loss of an executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names; without one, a folder below the home
    directory of the default file system, where cluster staging files go too.

    A folder of a single machine is refused unless the master is local.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    folder = (named or _home_folder(spark)).rstrip("/")
    if not named:
        if _on_one_machine(spark, folder) and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{folder} is local to one machine; name a shared folder in {CHECKPOINT_CONF}")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _home_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    fs = sc._jvm.org.apache.hadoop.fs.FileSystem.get(sc._jsc.hadoopConfiguration())
    return f"{fs.getHomeDirectory().toString()}/.holdfast"


def _on_one_machine(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nobody else writes to, below the shared folder."""
    return f"{shared_dir(spark)}/holdfast-{label}-{uuid.uuid4().hex}"


def land(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back: cuts lineage, keeps column pruning."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
