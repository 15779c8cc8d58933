"""Generated key columns: every key is a function of its position, so any number of tasks can make them."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.u64 import bits, low32

# Ship the functions used inside tasks by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEFAULT_SEED = 42


def naturals(spark: SparkSession, n: int, start: int = 0, partitions: int | None = None) -> DataFrame:
    """Keys ``start .. start + n - 1``."""
    return spark.range(start, start + n, 1, partitions).withColumnRenamed("id", "key")


def uniform(spark: SparkSession, n: int, seed: int = DEFAULT_SEED, partitions: int | None = None) -> DataFrame:
    """``n`` seeded draws ``(draw, key)``, uniform over 0..2**32-1, the same for any number of partitions."""
    return uniform_over(spark.range(0, n, 1, partitions).withColumnRenamed("id", "draw"), "draw", seed)


def uniform_over(draws: DataFrame, draw: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """One seeded draw ``(draw, key)`` for each row of a table, decided by its column ``draw``."""
    numbered = draws.select(F.col(draw).cast("bigint").alias("draw"))
    return numbered.select("draw", F.expr(low32(f"xxhash64(draw, {bits(seed)})")).alias("key"))


def from_generator(
    spark: SparkSession, n: int, generator: Callable[[np.ndarray], np.ndarray], partitions: int | None = None
) -> DataFrame:
    """``n`` keys from a user function that maps an array of positions to an array of unsigned keys."""
    return generated_over(spark.range(0, n, 1, partitions), "id", generator)


def generated_over(rows: DataFrame, position: str, generator: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """One key for each row of a table, from a user function over an array of the rows' positions."""

    def pull(batches):
        for batch in batches:
            positions = batch.column(0).to_numpy(zero_copy_only=False)
            keys = np.asarray(generator(positions)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], ["key"])

    return rows.select(F.col(position).cast("bigint").alias("position")).mapInArrow(pull, "key bigint")
