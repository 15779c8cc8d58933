"""Estimates checked against exact counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import error_bound_percent, error_percent
from ..functions.hashes import HashFunction, get_hash
from ..functions.u64 import step
from .estimate import finish, register_sums, words_for
from .registers import check_groups, ranks, smallest_hashes


def exact_distinct(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.countDistinct(key).alias("exact"))


def with_error(df: DataFrame, p: int, exact: str = "exact", estimate: str = "estimate") -> DataFrame:
    """Add ``error_pct``, ``bound_pct`` (one standard error) and ``out_of_range``."""
    bound = f"{error_bound_percent(p)!r}D"
    with_error_pct = step(df, error_pct=error_percent(estimate, f"nullif({exact}, 0)"), bound_pct=bound)
    return step(with_error_pct, out_of_range="coalesce(abs(error_pct) > bound_pct, false)")


def error_report(
    df: DataFrame, key: str, p: int = 14, hash: str | HashFunction = "murmur3_32", by: Sequence[str] = ()
) -> DataFrame:
    """``(by..., exact, estimate, error_pct, bound_pct, out_of_range)`` from one pass over the distinct keys.

    The exact count and the sketch share the deduplicating shuffle: every bucket carries its number of distinct keys.
    """
    words = words_for(get_hash(hash).width)
    distinct = df.select(*check_groups(by), F.col(key).alias("__exact_key")).distinct()
    counted = smallest_hashes(distinct, "__exact_key", p, hash, by, [F.count("bucket").alias("__keys")])
    ranked = ranks(counted, p, hash, by, ["__keys"])
    sums = ranked.groupBy(*by).agg(F.coalesce(F.sum("__keys"), F.lit(0)).alias("exact"), *register_sums(words))
    report = finish(sums, p, words, [*by, "exact"]).select(*by, "exact", "estimate")
    return with_error(report, p)
