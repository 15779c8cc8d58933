"""Packed lines: several keys per row with a byte mask and an end marker, ``(seq, lanes, keep, last)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import KEY_BYTES, keys_in_line, lane_is_valid, length_to_keep
from ..functions.u64 import step

LINE_SCHEMA = "seq BIGINT, lanes ARRAY<BIGINT>, keep BIGINT, last BOOLEAN"


def pack_lines(keys: DataFrame, order: str, key: str, width: int, lanes: int = 16) -> DataFrame:
    """Pack keys with dense order values 0, 1, 2, ... into lines of ``width`` keys, padded to ``lanes``.

    A line holds at most ``width`` keys, so the collected group is bounded.
    """
    if not 1 <= width <= lanes <= 16:
        raise ValueError(f"need 1 <= width <= lanes <= 16, got width={width}, lanes={lanes}")
    item = F.struct(F.col(order).alias("o"), F.col(key).cast("bigint").alias("k"))
    seq = F.call_function("div", F.col(order), F.lit(width).cast("bigint")).alias("seq")
    grouped = keys.groupBy(seq).agg(F.array_sort(F.collect_list(item)).alias("items"))
    padding = F.array_repeat(F.lit(None).cast("bigint"), F.lit(lanes) - F.size("items"))
    return grouped.select(
        "seq",
        F.concat(F.transform("items", lambda x: x["k"]), padding).alias("lanes"),
        F.expr(length_to_keep(f"size(items) * {KEY_BYTES}")).alias("keep"),
    )


def unpack_lines(lines: DataFrame, carry: Sequence[str] = ("seq", "last"), padding: str = "drop") -> DataFrame:
    """One row per lane: ``(carry..., lane, key, valid)``.

    ``padding='drop'`` keeps valid lanes only; ``'as_zero'`` keeps all and turns the invalid ones into key 0.
    """
    if padding not in ("drop", "as_zero"):
        raise ValueError(f"padding must be 'drop' or 'as_zero', got {padding!r}")
    exploded = lines.select(*carry, "keep", F.posexplode("lanes").alias("lane", "__key"))
    rows = step(exploded, valid=f"{lane_is_valid('keep', 'lane')} AND __key IS NOT NULL")
    if padding == "drop":
        return rows.where("valid").select(*carry, "lane", F.col("__key").alias("key"), "valid")
    return rows.select(*carry, "lane", F.expr("CASE WHEN valid THEN __key ELSE 0L END AS key"), "valid")


def count_lane_keys(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Keys carried by the lines according to their masks, without unpacking them."""
    return lines.groupBy(*by).agg(
        F.expr("count(1) AS lines"), F.expr(f"coalesce(sum({keys_in_line('keep')}), 0L) AS keys")
    )
