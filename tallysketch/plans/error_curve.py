"""Estimation error along a growing generated input, one column per hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import bucket_of, error_bound_percent, error_percent, rank_of
from ..functions.hashes import get_hash, hash_keys
from ..operators.cumulative import checkpoints, cumulative_exact, cumulative_from_registers, first_checkpoint
from ..operators.estimate import words_for
from ..sources.generators import naturals, uniform

DEFAULT_HASHES = ("MURMUR3_32", "MURMUR3_64", "SIP")


def error_curve(
    spark: SparkSession, hashes: Sequence[str] = DEFAULT_HASHES, limit: int = 1 << 32, p: int = 14,
    random: bool = False, truth: str = "exact", first: int = 100000, seed: int = 42,
) -> DataFrame:
    """``(cardinality, draws, expected, <hash>...)``: relative error in percent at every checkpoint below ``limit``.

    Keys are 0, 1, 2, ... or, with ``random``, seeded uniform draws.  For those the true cardinality is the number of
    different keys drawn; ``truth='draws'`` takes the number of draws instead.  Sort by ``cardinality`` for the report.
    """
    if truth not in ("exact", "draws"):
        raise ValueError(f"truth must be 'exact' or 'draws', got {truth!r}")
    for name in hashes:
        get_hash(name)
    series = checkpoints(limit, first)
    if not series:
        raise ValueError(f"no checkpoint below {limit}")
    drawn = uniform(spark, series[-1], seed) if random else naturals(spark, series[-1]).withColumn("draw", F.col("key"))
    return curve_over(drawn, series, hashes, p, "exact" if random and truth == "exact" else "draws")


def curve_over(
    drawn: DataFrame, series: Sequence[int], hashes: Sequence[str] = DEFAULT_HASHES, p: int = 14, truth: str = "exact",
) -> DataFrame:
    """The curve over given keys ``(draw, key)``, ``draw`` numbering them from 0 on.

    Rows past the last checkpoint take no part.  The keys are read once for all hashes.  With ``truth='draws'`` the
    checkpoint itself is taken as the true cardinality.
    """
    keys = drawn.select("key", F.expr(first_checkpoint("draw", series)).alias("checkpoint")).where("checkpoint IS NOT NULL")
    words = max(words_for(get_hash(name).width) for name in hashes)
    estimates = cumulative_from_registers(_all_registers(keys, hashes, p), "checkpoint", p, words, ["label"])
    if truth == "exact":
        known = cumulative_exact(keys, "key", "checkpoint")
    else:
        known = drawn.sparkSession.createDataFrame([(c, c) for c in series], "checkpoint BIGINT, exact BIGINT")
    rows = known.select(
        "checkpoint", "exact", F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("estimate")
    ).unionByName(estimates.select("checkpoint", F.lit(None).cast("bigint").alias("exact"), "label", "estimate"))
    # One row per checkpoint and hash: a small aggregate lines the columns up without joins.
    lined = rows.groupBy("checkpoint").agg(
        F.max("exact").alias("cardinality"),
        *[F.max(F.when(F.col("label") == name, F.col("estimate"))).alias(name) for name in hashes],
    )
    return lined.select(
        "cardinality", F.col("checkpoint").alias("draws"), F.lit(error_bound_percent(p)).alias("expected"),
        *[F.expr(error_percent(f"`{name}`", "cardinality")).alias(name) for name in hashes],
    )


def _all_registers(keys: DataFrame, hashes: Sequence[str], p: int) -> DataFrame:
    """Registers ``(label, checkpoint, bucket, rank)`` of several hashes from one reading of the keys."""
    hashed = keys.where("key IS NOT NULL")
    for i, name in enumerate(hashes):
        spec = get_hash(name)
        if spec.width > 64:
            raise ValueError(f"{name} is too wide for a curve")
        hashed = hash_keys(hashed, "key", spec, f"__hash{i}")
    found = [
        f"named_struct('label', '{name}', 'bucket', {bucket_of(f'__hash{i}', get_hash(name).width, p)}, 'hash', __hash{i})"
        for i, name in enumerate(hashes)
    ]
    stacked = hashed.selectExpr("checkpoint", f"inline(array({', '.join(found)}))")
    # The smallest hash of a bucket has the largest rank: see registers.
    smallest = stacked.groupBy("label", "checkpoint", "bucket").agg(F.min("hash").alias("__min"))
    rank = " ".join(f"WHEN '{name}' THEN {rank_of('__min', get_hash(name).width, p)}" for name in hashes)
    return smallest.select("label", "checkpoint", "bucket", F.expr(f"CASE label {rank} END").alias("rank"))
