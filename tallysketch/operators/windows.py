"""Count-based windows over packets and marker-based runs over lines.

Windows are found on ``(by, seq, length, tuples)`` alone, stored between the passes; the rest of a packet, its payload above
all, meets the outcome in one join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import is_not_empty, tuples_in_packet
from ..functions.hashes import HashFunction, get_hash
from ..functions.u64 import step
from ..storage import stored
from .estimate import estimate_registers
from .registers import build_registers
from .running import BLOCK_BITS, levels_for, running

RESULT_BYTES = 4

Keep = Callable[[DataFrame], DataFrame]


def packet_tuples(packets: DataFrame) -> DataFrame:
    """Non-empty packets with a ``tuples`` column: whole keys per packet, unless the input brings its own."""
    used = packets.where(is_not_empty("length"))
    return used if "tuples" in used.columns else step(used, tuples=tuples_in_packet("length"))


def running_tuples(
    packets: DataFrame, by: Sequence[str] = (), out: str = "running", bits: int = BLOCK_BITS, levels: int | None = None,
) -> DataFrame:
    """Running count of whole keys over the non-empty packets, in ``seq`` order."""
    levels = levels or levels_for(packets, "seq", bits)
    return running(packet_tuples(packets), "seq", {out: F.col("tuples")}, by, bits=bits, levels=levels)


def run_ids(
    lines: DataFrame, order: str = "seq", last: str = "last", out: str = "run_id", by: Sequence[str] = (),
    bits: int = BLOCK_BITS, levels: int | None = None,
) -> DataFrame:
    """Number the runs of a stream cut by an end marker: the count of earlier markers."""
    return running(lines, order, {out: F.col(last).cast("int")}, by, inclusive=False, bits=bits, levels=levels)


def _closed_windows(closing: DataFrame, by: Sequence[str], bits: int) -> DataFrame:
    """Length of the unbroken series 1, 2, 3, ... of window numbers per group, as ``__closed``.

    Different whole numbers in order are unbroken up to one that has as many before it as it is large. That is asked of the
    numbers in blocks of ``2**bits``, and then of the blocks that are full.
    """
    group = F.struct(*by).alias("__key") if by else F.lit(0).alias("__key")
    blocks = closing.select(group, F.expr(f"shiftright(__number - 1, {bits})").alias("__block"), F.expr("__number - 1 AS __n"))
    inside = "count(1) OVER (PARTITION BY __key, __block ORDER BY __n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    counted = step(blocks, __before=inside).groupBy("__key", "__block").agg(
        F.expr(f"count_if(__n - shiftleft(__block, {bits}) = __before) AS __unbroken"))
    full = f"CAST(__unbroken = shiftleft(1L, {bits}) AS BIGINT)"
    before = f"sum({full}) OVER (PARTITION BY __key ORDER BY __block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    reached = step(counted, __full=f"coalesce({before}, 0L)").where("__full = __block")
    ends = reached.groupBy("__key").agg(F.expr(f"max(shiftleft(__block, {bits}) + __unbroken) AS __closed"))
    return ends.where("__closed > 0").select(*[F.col(f"__key.{c}") for c in by], "__closed")


def attach_group_value(
    rows: DataFrame, values: DataFrame, by: Sequence[str], column: str, spread: str = "seq", bits: int = BLOCK_BITS
) -> DataFrame:
    """Add each group's ``column`` from ``values`` (one row per group) to its rows, NULL where the group is missing.

    Values are first given to the blocks of ``2**bits`` values of the integer column ``spread`` that a group has, and the
    rows meet them by group and block, so a group holding most of the rows is not sent to one task.
    """
    if not by:
        # A single row, whatever the input size.
        return rows.withColumn(column, values.select(column).scalar())
    # One struct key: two NULL group values inside it compare equal.
    tagged = rows.withColumns({"__key": F.struct(*by), "__part": F.expr(f"coalesce(shiftright({spread}, {bits}), 0)")})
    known = values.select(F.struct(*by).alias("__key"), F.col(column).alias("__found"))
    parts = tagged.select("__key", "__part").distinct().join(known, "__key")
    return tagged.join(parts, ["__key", "__part"], "left").select(*rows.columns, F.col("__found").alias(column))


def with_places(packets: DataFrame, places: DataFrame, by: Sequence[str]) -> DataFrame:
    """Packets with the columns that ``places`` has beyond theirs, by group and ``seq``."""
    new = [c for c in places.columns if c not in packets.columns]
    if not by:
        return packets.join(places.select("seq", *new), "seq").select(*packets.columns, *new)
    # One struct key: two NULL group values inside it compare equal.
    left = packets.withColumn("__key", F.struct(*by))
    right = places.select(F.struct(*by).alias("__key"), "seq", *new)
    return left.join(right, ["__key", "seq"]).select(*packets.columns, *new)


def _narrow(used: DataFrame, by: Sequence[str], *more: str) -> DataFrame:
    return used.select(*dict.fromkeys([*by, "seq", "length", "tuples", *more]))


def _count_places(narrow: DataFrame, size: int, by: Sequence[str], bits: int, levels: int, keep: Keep) -> DataFrame:
    counted = keep(running(narrow, "seq", {"running": F.col("tuples")}, by, bits=bits, levels=levels))
    ends_here = f"(tuples > 0 AND running % {size} = 0)"
    closing = counted.where(ends_here).select(*by, F.expr(f"running div {size} AS __number"))
    rows = attach_group_value(counted, _closed_windows(closing, by, bits), by, "__closed", bits=bits)
    series, number = "coalesce(__closed, 0L)", f"running div {size}"
    rows = step(rows, closes=f"{ends_here} AND {number} <= {series}")
    rows = step(rows, window_id=f"least({number}, {series}) + 1 - CAST(closes AS BIGINT)")
    return step(rows, window_closed=f"window_id <= {series}").drop("__closed")


def count_windows(
    packets: DataFrame, size: int, by: Sequence[str] = (), bits: int = BLOCK_BITS, levels: int | None = None,
    keep: Keep | None = None,
) -> DataFrame:
    """Assign non-empty packets to windows of ``size`` keys; adds ``running``, ``window_id``, ``closes`` and
    ``window_closed``.

    A window closes at the packet whose running count reaches its end exactly, and only after all earlier windows have
    closed; a packet belongs wholly to one window.  Once a window overshoots, it stays open for good.  ``by`` gives each
    group its own windows; without it one window series spans all packets.  For windows that close
    at the first packet reaching ``size`` see ``reach.reaching_windows``.  The counts are stored on the way, by ``keep`` if
    it is given: it takes a table and returns it as stored.
    """
    if size < 1:
        raise ValueError(f"size must be positive, got {size}")
    used = packet_tuples(packets)
    levels = levels or levels_for(packets, "seq", bits)
    keep = keep or (lambda df: stored(df, "counts"))
    narrow = _narrow(used, by)
    places = _count_places(narrow, size, by, bits, levels, keep)
    if set(used.columns) == set(narrow.columns):
        return places.select(*used.columns, "running", "closes", "window_id", "window_closed")
    return with_places(used, places, by)


def place_packets(
    packets: DataFrame, assign: Callable[[DataFrame], DataFrame], by: Sequence[str] = (), bits: int = BLOCK_BITS,
    levels: int | None = None, keep: Keep | None = None, marker: str | None = None,
) -> DataFrame:
    """Non-empty packets with what ``assign`` (one of the window functions) adds, and ``offset``: where each packet's payload
    begins in its window.

    ``assign`` sees the group columns, ``seq``, ``length``, ``tuples`` and the ``marker`` column only. Its outcome is stored, by
    ``keep`` if it is given; the packets then join it, the one time that payloads are shuffled.
    """
    used = packet_tuples(packets)
    levels = levels or levels_for(packets, "seq", bits)
    keep = keep or (lambda df: stored(df, "places"))
    windowed = assign(_narrow(used, by, *([marker] if marker else [])))
    return with_places(used, keep(payload_offsets(windowed, by, bits, levels)), by)


def marked_windows(
    packets: DataFrame, by: Sequence[str] = (), last: str = "last", bits: int = BLOCK_BITS, levels: int | None = None,
) -> DataFrame:
    """Like ``count_windows``, but a window closes at every packet whose ``last`` flag is set."""
    used = packet_tuples(packets)
    levels = levels or levels_for(packets, "seq", bits)
    numbered = run_ids(used, last=last, out="__earlier", by=by, bits=bits, levels=levels)
    ends = used.groupBy(*by).agg(F.coalesce(F.sum(F.col(last).cast("bigint")), F.lit(0)).alias("__closed"))
    rows = attach_group_value(numbered, ends, by, "__closed")
    return rows.select(
        *used.columns, F.expr("__earlier + 1 AS window_id"), F.col(last).alias("closes"),
        F.expr("__earlier < __closed AS window_closed"),
    )


def estimate_windows(
    windowed: DataFrame, p: int = 16, hash: str | HashFunction = "murmur3_64_h1", by: Sequence[str] = ()
) -> DataFrame:
    """Distinct-count estimate of every closed window of ``count_windows``."""
    group = [*by, "window_id"]
    keys = windowed.where("window_closed").select(*group, F.explode("payload").alias("key"))
    registers = build_registers(keys, "key", p, hash, group)
    return estimate_registers(registers, p, get_hash(hash).width, group)


def payload_offsets(
    windowed: DataFrame, by: Sequence[str] = (), bits: int = BLOCK_BITS, levels: int | None = None,
) -> DataFrame:
    """Byte offset of each packet's payload inside its window."""
    return running(
        windowed, "seq", {"offset": F.col("length")}, [*by, "window_id"], inclusive=False, bits=bits, levels=levels
    )


def window_results(windowed: DataFrame, estimates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Where each closed window's result goes: right behind its payload."""
    group = [*by, "window_id"]
    ends = windowed.where("window_closed").groupBy(*group).agg(F.sum(F.col("length").cast("bigint")).alias("offset"))
    # Both sides hold one row per window; the union lines them up without a join.
    parts = ends.select(*group, "offset", F.lit(None).cast("double").alias("estimate")).unionByName(
        estimates.select(*group, F.lit(None).cast("bigint").alias("offset"), "estimate")
    )
    return parts.groupBy(*group).agg(
        F.max("offset").alias("offset"),
        F.lit(RESULT_BYTES).cast("bigint").alias("length"),
        F.coalesce(F.max("estimate"), F.lit(0.0)).alias("estimate"),
    )
