"""Register tables: the sketch as an ordinary DataFrame ``(group..., bucket INT, rank TINYINT)``.

Only registers with rank >= 1 have a row; an absent bucket is an empty register.  A group that has rows without a key
also has a row with NULL as bucket and rank 0, so that a group without any key keeps its place (and its estimate, 0).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import bit_length, bucket_of, rank_of, rest_of
from ..functions.hashes import HashFunction, get_hash, hash_keys
from ..functions.u64 import bits, step

MIN_P, MAX_P = 4, 16
# Columns the operators add: groups can't be called so.
RESERVED = frozenset(
    ["bucket", "rank", "p", "hash", "estimate", "zeros", "harmonic", "raw", "nonempty", "registers", "exact", "batch_id"]
)


def check_groups(by: Sequence[str]) -> tuple[str, ...]:
    """Raise on group columns that would be overwritten: names the operators use, case apart."""
    taken = [c for c in by if c.lower() in RESERVED or c.startswith("__") or c.lower().startswith("word")
             and c[4:].isdigit()]
    if taken:
        raise ValueError(f"rename the group columns {', '.join(taken)}: these names are used by the sketch itself")
    return tuple(by)


def valid_p(p: str | Column) -> Column:
    """Whether a column holds a usable number of bucket bits."""
    column = F.col(p) if isinstance(p, str) else p
    return F.coalesce(column.between(MIN_P, MAX_P), F.lit(False))


def check_p(p: int) -> int:
    if not isinstance(p, int) or not MIN_P <= p <= MAX_P:
        raise ValueError(f"p must be an integer in [{MIN_P}, {MAX_P}], got {p!r}")
    return p


def register_count(p: int) -> int:
    return 1 << check_p(p)


def _smallest(spec: HashFunction, p: int) -> list[Column]:
    """Aggregates that keep, per bucket, the hash with the most leading zeros below the bucket index.

    Within a bucket the rank falls as the hash grows, so the smallest hash carries the largest rank.  MIN over a
    primitive column keeps the aggregate hash-based, and the leading zeros are counted once per register, not per row.
    """
    if spec.width < 128:
        return [F.min("__hash").alias("__min")]
    # The low word decides only where the high word's remaining bits are all zero; flip its sign bit to order unsigned.
    rest = rest_of("__hash.hi", 64, p)
    low = f"CASE WHEN {rest} = 0 THEN __hash.lo ^ {bits(1 << 63)} END"
    return [F.expr(f"min({rest})").alias("__min"), F.expr(f"min({low})").alias("__min_low")]


def _rank(spec: HashFunction, p: int) -> Column:
    if spec.width < 128:
        return F.expr(f"CASE WHEN bucket IS NULL THEN 0Y ELSE {rank_of('__min', spec.width, p)} END").alias("rank")
    from_high = f"{64 - p + 1} - {bit_length('__min')}"
    from_low = f"{128 - p + 1} - {bit_length(f'(__min_low ^ {bits(1 << 63)})')}"
    found = f"CASE WHEN bucket IS NULL THEN 0 WHEN __min = 0 THEN {from_low} ELSE {from_high} END"
    return F.expr(f"CAST({found} AS TINYINT)").alias("rank")


def smallest_hashes(
    df: DataFrame, key: str, p: int = 14, hash: str | HashFunction = "murmur3_32", by: Sequence[str] = (),
    extra: Sequence[Column] = (),
) -> DataFrame:
    """The aggregation half of a register build (also the stateful half of a stream); ``extra`` adds aggregates."""
    check_p(p)
    spec = get_hash(hash)
    # Without groups there is nothing to keep for NULL keys.
    hashed = hash_keys(df.select(*by, F.col(key).alias("__k")), "__k", spec, "__hash", keep_nulls=bool(by))
    word = "__hash" if spec.width < 128 else "__hash.hi"
    bucket = bucket_of(word, min(spec.width, 64), p)
    bucketed = step(hashed, bucket=f"CASE WHEN __k IS NOT NULL THEN {bucket} END" if by else bucket)
    return bucketed.groupBy(*by, "bucket").agg(*_smallest(spec, p), *extra)


def ranks(
    smallest: DataFrame, p: int, hash: str | HashFunction, by: Sequence[str] = (), extra: Sequence[str] = ()
) -> DataFrame:
    """Turn the smallest hash of each bucket into its rank."""
    return smallest.select(*by, "bucket", _rank(get_hash(hash), p), *extra)


def build_registers(
    df: DataFrame, key: str, p: int = 14, hash: str | HashFunction = "murmur3_32", by: Sequence[str] = (),
    padding: str = "drop",
) -> DataFrame:
    """Sketch a key column: one row per non-empty register.

    Every task pre-aggregates, so it sends at most ``2**p`` rows per group, and the shuffle key includes the bucket, so
    even a single huge group spreads over the cluster.  ``padding='as_zero'`` counts a NULL key as key 0.
    """
    check_groups(by)
    if padding not in ("drop", "as_zero"):
        raise ValueError(f"padding must be 'drop' or 'as_zero', got {padding!r}")
    if padding == "as_zero":
        df = df.withColumn(key, F.coalesce(F.col(key), F.lit(0)))
    return ranks(smallest_hashes(df, key, p, hash, by), p, hash, by)


def merge_registers(*tables: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest rank per bucket over any number of register tables; dropping a column from ``by`` rolls up along it."""
    columns = [*by, "bucket", "rank"]
    together = reduce(DataFrame.unionByName, [t.select(*columns) for t in tables])
    return together.groupBy(*by, "bucket").agg(F.max("rank").alias("rank"))


def rank_histogram(registers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return registers.where("rank > 0").groupBy(*by, "rank").agg(F.count(F.lit(1)).alias("registers"))


def zero_count(registers: DataFrame, p: int, by: Sequence[str] = ()) -> DataFrame:
    """Empty registers per group."""
    return registers.groupBy(*by).agg((F.lit(register_count(p)) - F.expr("count_if(rank > 0)")).alias("zeros"))


def dense_registers(registers: DataFrame, p: int, by: Sequence[str] = ()) -> DataFrame:
    """All ``2**p`` registers per group in bucket order, empty ones as rank 0 (a dump: much larger than the sketch)."""
    spark = registers.sparkSession
    m = register_count(p)
    if by:
        groups = registers.select(*by).distinct()
        grid = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("bucket"))
    else:
        grid = spark.range(m).select(F.col("id").cast("int").alias("bucket"))
    keys = [*by, "bucket"]
    # max() over the union fills the gaps without joining, so NULL group values need no special care.
    empty = grid.select(*keys, F.lit(0).cast("tinyint").alias("rank"))
    filled = empty.unionByName(registers.where("rank > 0").select(*keys, "rank")).groupBy(*keys).agg(F.max("rank").alias("rank"))
    return filled.orderBy(*keys)
