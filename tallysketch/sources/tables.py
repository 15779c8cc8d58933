"""Key columns of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import check_key_type


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_keys(spark: SparkSession, folder: str, name: str, column: str) -> DataFrame:
    """One column of whole numbers of a Parquet table as ``key BIGINT``; only that column is read."""
    table = read_table(spark, folder, name)
    check_key_type(table, column)
    return table.select(F.col(column).cast("bigint").alias("key"))
