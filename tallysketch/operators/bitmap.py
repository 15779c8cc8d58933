"""Exact distinct counts that can be merged: bitmaps over 32-bit keys, rolled up without the keys.

A key is one bit of a bitmap of 32,768: its bucket is a row key, its place a bit. Built-in aggregates set the bits before
the shuffle and combine bitmaps after it, so a stored table answers any coarser grouping exactly. A group takes at most 4 KB
for each 32,768 keys it could have, whatever the number of rows; for sketches of fixed size see ``registers``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registers import check_groups

MAX_KEY = (1 << 32) - 1


def build_bitmaps(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., part, bits)`` of a column of keys 0..2^32-1; other keys raise. A group whose keys are all NULL keeps one row
    with NULL as part."""
    check_groups(by)
    known = F.col(key).cast("bigint")
    outside = F.raise_error(F.concat(F.lit(f"{key} must be between 0 and {MAX_KEY}, got "), F.col(key).cast("string")))
    checked = F.when(known.isNull() | known.between(0, MAX_KEY), known).otherwise(outside.cast("bigint"))
    rows = df.select(*by, checked.alias("__key"))
    if not by:
        rows = rows.where(F.col("__key").isNotNull())
    return rows.groupBy(*by, F.bitmap_bucket_number("__key").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("__key")).alias("bits"))


def merge_bitmaps(*tables: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The union of the keys of any number of bitmap tables; dropping a column from ``by`` rolls up along it."""
    together = None
    for table in tables:
        rows = table.select(*by, "part", "bits")
        together = rows if together is None else together.unionByName(rows)
    return together.groupBy(*by, "part").agg(F.bitmap_or_agg("bits").alias("bits"))


def count_bitmaps(bitmaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., exact)``: distinct keys of each group of a merged (or freshly built) table; no rows without groups give 0."""
    counts = F.coalesce(F.sum(F.bitmap_count(F.when(F.col("part").isNotNull(), F.col("bits")))), F.lit(0))
    return bitmaps.groupBy(*by).agg(counts.alias("exact"))
