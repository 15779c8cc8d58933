"""Estimates at growing checkpoints of one data set, from a single pass over the keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashes import HashFunction, get_hash
from .estimate import finish, rank_word, words_for
from .registers import build_registers

# Fixed values of the checkpoint series.
FIRST_CHECKPOINT = 100000
GROWTH = 1.15478197
LIMIT = 1 << 32


def checkpoints(limit: int = LIMIT, first: int = FIRST_CHECKPOINT, growth: float = GROWTH) -> list[int]:
    """``first`` and its successive multiples by ``growth``, truncated, while below ``limit``."""
    if first < 1 or int(growth * first) <= first:
        raise ValueError("checkpoints must grow")
    series, n = [], first
    while n < limit:
        series.append(n)
        n = int(growth * n)
    return series


def first_checkpoint(position: str, series: Sequence[int]) -> str:
    """Smallest checkpoint above a 0-based position, NULL past the last one (a balanced tree of comparisons)."""
    if len(series) == 1:
        return f"CASE WHEN {position} < {series[0]}L THEN {series[0]}L END"
    half = len(series) // 2
    below, above = first_checkpoint(position, series[:half]), first_checkpoint(position, series[half:])
    return f"CASE WHEN {position} < {series[half - 1]}L THEN {below} ELSE {above} END"


def cumulative_estimates(
    df: DataFrame, key: str, checkpoint: str, p: int = 14, hash: str | HashFunction = "murmur3_32",
    by: Sequence[str] = (),
) -> DataFrame:
    """``(by..., checkpoint, estimate, zeros, harmonic, raw)``: distinct keys seen up to and including each checkpoint.

    A register contributes to the running sums only where it grows, so nothing is spread over a checkpoint-by-bucket
    grid.  The last window holds one row per checkpoint and group.
    """
    registers = build_registers(df, key, p, hash, [*by, checkpoint])
    return cumulative_from_registers(registers, checkpoint, p, words_for(get_hash(hash).width), by)


def cumulative_from_registers(
    registers: DataFrame, checkpoint: str, p: int, words: int, by: Sequence[str] = ()
) -> DataFrame:
    """The same from registers ``(by..., checkpoint, bucket, rank)``."""
    earlier = Window.partitionBy(*by, "bucket").orderBy(checkpoint).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("rank").over(earlier), F.lit(0).cast("tinyint"))
    grown = registers.withColumn("__before", before).withColumn("__now", F.greatest("rank", "__before"))
    steps = grown.groupBy(*by, checkpoint).agg(
        F.expr("count_if(__before = 0 AND __now > 0) AS __nonempty"),
        *[F.expr(f"sum({rank_word('__now', i)} - {rank_word('__before', i)}) AS __word{i}") for i in range(words)],
    )
    so_far = Window.partitionBy(*by).orderBy(checkpoint).rowsBetween(Window.unboundedPreceding, 0)
    sums = steps.select(
        *by, checkpoint, F.sum("__nonempty").over(so_far).alias("nonempty"),
        *[F.sum(f"__word{i}").over(so_far).alias(f"word{i}") for i in range(words)],
    )
    return finish(sums, p, words, [*by, checkpoint])


def cumulative_exact(df: DataFrame, key: str, checkpoint: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., checkpoint, exact)``: each key counts from the first checkpoint it appears at."""
    seen = df.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.min(checkpoint).alias("__first"))
    new = seen.groupBy(*by, F.col("__first").alias(checkpoint)).agg(F.count(F.lit(1)).alias("__new"))
    every = df.select(*by, checkpoint).distinct().withColumn("__new", F.lit(0).cast("bigint"))
    steps = new.unionByName(every).groupBy(*by, checkpoint).agg(F.sum("__new").alias("__new"))
    so_far = Window.partitionBy(*by).orderBy(checkpoint).rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(*by, checkpoint, F.sum("__new").over(so_far).alias("exact"))
