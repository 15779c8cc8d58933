"""Merging and splitting ordered inputs: items carry ``seq``; packets are runs of lines ended by ``last``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import BLOCK_BITS, running
from .windows import run_ids


def _tagged(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.withColumn("source", F.lit(0)).unionByName(second.withColumn("source", F.lit(1)))


def merge_priority(first: DataFrame, second: DataFrame) -> DataFrame:
    """All items of both inputs; the first input's come first when sorted by ``(source, seq)``."""
    return _tagged(first, second)


def item_turns(items: DataFrame, by: Sequence[str] = (), order: str = "seq", bits: int = BLOCK_BITS) -> DataFrame:
    """Add ``turn``, the 0-based position of an item within its group."""
    return running(items, order, {"turn": F.lit(1)}, by, inclusive=False, bits=bits)


def merge_fair(first: DataFrame, second: DataFrame, packets: bool = False, bits: int = BLOCK_BITS) -> DataFrame:
    """Alternate between two inputs, item by item or packet by packet, until one runs out.

    The order is ``(turn, source)``, and ``seq`` inside a packet.
    """
    both = _tagged(first, second)
    if packets:
        return run_ids(both, out="turn", by=["source"], bits=bits)
    return item_turns(both, ["source"], bits=bits)


def merge_by_origin(
    origin: DataFrame, first: DataFrame, second: DataFrame, packets: bool = False, bits: int = BLOCK_BITS
) -> DataFrame:
    """Interleave two inputs in the order an origin table ``(position, source)`` prescribes.

    The n-th entry naming a source takes that source's n-th item (or packet); the result has ``position`` and is ordered
    by it (then by ``seq`` inside a packet).  Items beyond the last entry are not taken.
    """
    slots = running(origin, "position", {"turn": F.lit(1)}, ["source"], inclusive=False, bits=bits)
    return merge_fair(first, second, packets, bits).join(slots, ["source", "turn"]).drop("turn")


def split_packets(
    lines: DataFrame, destinations: DataFrame, bits: int = BLOCK_BITS
) -> tuple[DataFrame, DataFrame]:
    """Route the n-th packet of ``lines`` by the n-th flag of ``destinations (packet, dest)``: 0 and 1.

    Every packet goes somewhere: one without a flag, or with a NULL flag, to the first output.
    """
    routed = run_ids(lines, out="packet", bits=bits).join(destinations, "packet", "left")
    second = F.coalesce(F.col("dest") != 0, F.lit(False))
    return routed.where(~second), routed.where(second)
