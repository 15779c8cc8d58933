"""Whole flows from a raw source to a written result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import get_hash
from ..operators.estimate import estimate_registers
from ..operators.registers import build_registers
from ..operators.running import levels_for
from ..operators.sketch import approx_distinct
from ..operators.windows import count_windows, estimate_windows, place_packets, run_ids, window_results
from ..sources.extents import read_extent
from ..sources.lines import unpack_lines
from ..sources.sinks import write_result


def estimate_extent(
    spark: SparkSession, path: str, result_path: str, offset: int = 0, length: int | None = None, p: int = 16,
    hash: str = "murmur3_64_h1",
) -> None:
    """Estimate the distinct keys of a raw byte range and append the result to ``result_path``."""
    write_result(approx_distinct(read_extent(spark, path, offset, length), "key", p, hash), result_path)


def estimate_runs(
    lines: DataFrame, p: int = 16, hash: str = "murmur3_64_h1", padding: str = "drop", by: Sequence[str] = ()
) -> DataFrame:
    """Estimate every finished run of a line stream cut by ``last``: ``(by..., run_id, estimate)``."""
    group = [*by, "run_id"]
    numbered = run_ids(lines, by=by)
    keys = unpack_lines(numbered, [*group, "last"], padding)
    registers = build_registers(keys, "key", p, hash, group)
    estimates = estimate_registers(registers, p, get_hash(hash).width, group)
    # One row per run on both sides: the union keeps finished runs without any valid key.
    ends = numbered.where("last").select(*group, F.lit(0.0).alias("estimate"), F.lit(True).alias("finished"))
    both = estimates.select(*group, "estimate", F.lit(False).alias("finished")).unionByName(ends)
    runs = both.groupBy(*group).agg(F.max("estimate").alias("estimate"), F.max("finished").alias("finished"))
    return runs.where("finished").drop("finished")


def tee_windows(
    packets: DataFrame, size: int, p: int = 16, hash: str = "murmur3_64_h1", by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Payloads with their offsets, and the result behind each closed window (rule ``'exact'``)."""
    levels = levels_for(packets, "seq")
    placed = place_packets(packets, lambda narrow: count_windows(narrow, size, by, levels=levels), by, levels=levels)
    payload = placed.select(*by, "window_id", "seq", "offset", "length", "payload")
    return payload, window_results(placed, estimate_windows(placed, p, hash, by), by)
