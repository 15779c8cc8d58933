"""Folders every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    A local session runs everything on this machine, so where the setting is missing a new local folder serves; anywhere
    else a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master == "local" or master.startswith("local["):
        return f"file://{tempfile.mkdtemp(prefix='tallysketch-')}"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path below the shared folder that no other run uses; it is deleted when the session's JVM ends in order."""
    path = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written below the shared folder and read back: what follows starts from the table and plans nothing twice."""
    folder = new_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
