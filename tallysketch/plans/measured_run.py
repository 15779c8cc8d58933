"""A sketch over generated or given keys, reported with its error and its times."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import KEY_BYTES
from ..functions.hashes import get_hash
from ..operators.estimate import estimate_registers
from ..operators.quality import exact_distinct, with_error
from ..operators.registers import build_registers, check_p
from ..sources.generators import naturals


@dataclass(frozen=True)
class Counters:
    """Keys read and registers written by one run."""

    consumed: int
    produced: int


def counted_registers(df: DataFrame, key: str, p: int, hash: str) -> tuple[DataFrame, Observation, Observation]:
    """A register build that counts keys in and registers out while it runs (read after an action)."""
    consumed, produced = Observation(), Observation()
    watched = df.observe(consumed, F.count(F.col(key)).alias("keys"))
    registers = build_registers(watched, key, p, hash).observe(produced, F.count(F.lit(1)).alias("registers"))
    return registers, consumed, produced


def run_counters(df: DataFrame, key: str, p: int = 14, hash: str = "murmur3_32") -> Counters:
    registers, consumed, produced = counted_registers(df, key, p, hash)
    registers.write.format("noop").mode("overwrite").save()
    return Counters(consumed.get["keys"], produced.get["registers"])


def measured_run(
    spark: SparkSession, hash: str, n: int, p: int = 16, partitions: int | None = None
) -> DataFrame:
    """``measure`` over the generated keys 0..n-1."""
    check_p(p)
    if n < 1:
        raise ValueError(f"n must be positive, got {n}")
    return measure(naturals(spark, n, partitions=partitions), "key", hash, p)


def measure(df: DataFrame, key: str, hash: str, p: int = 16) -> DataFrame:
    """Sketch a key column and report ``(hash, p, partitions, keys, exact, estimate, error_pct, bound_pct,
    out_of_range, collection_s, total_s, mb_per_s)``.

    Collection is the register build alone; the total is a job that goes on to the estimate.
    """
    check_p(p)
    spec = get_hash(hash)
    spark = df.sparkSession
    begin = time.perf_counter()
    counters = run_counters(df, key, p, spec.name)
    collection = time.perf_counter() - begin
    begin = time.perf_counter()
    estimate = estimate_registers(build_registers(df, key, p, spec), p, spec.width).first()["estimate"]
    total = time.perf_counter() - begin
    row = [(
        hash, p, df.rdd.getNumPartitions(), counters.consumed, exact_distinct(df, key).first()["exact"], estimate,
        collection, total, KEY_BYTES * counters.consumed / collection / 1e6,
    )]
    frame = spark.createDataFrame(
        row, "hash STRING, p INT, partitions INT, keys BIGINT, exact BIGINT, estimate DOUBLE, collection_s DOUBLE,"
        " total_s DOUBLE, mb_per_s DOUBLE",
    )
    report = with_error(frame, p)
    return report.select(
        "hash", "p", "partitions", "keys", "exact", "estimate", "error_pct", "bound_pct", "out_of_range",
        "collection_s", "total_s", "mb_per_s",
    )
