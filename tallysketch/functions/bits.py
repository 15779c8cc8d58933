"""Bucket, rank, lane-mask and packet-length expressions, as SQL expression text."""

from __future__ import annotations

from .u64 import bits

KEY_BYTES = 4
KEY_SHIFT = 2


def bit_length(a: str) -> str:
    """Number of significant bits of a BIGINT read as unsigned (0 for 0).

    Meant for the few rows left after aggregation; the per-row path never needs it (see ``operators.registers``).
    """
    return f"(CASE WHEN {a} = 0 THEN 0 ELSE length(bin({a})) END)"


def bucket_of(h: str, width: int, p: int) -> str:
    """Top ``p`` bits of a ``width``-bit hash."""
    return f"CAST(shiftrightunsigned({h}, {width - p}) AS INT)"


def rest_of(h: str, width: int, p: int) -> str:
    """The ``width - p`` bits below the bucket index."""
    return f"({h} & {bits((1 << (width - p)) - 1)})"


def leading_zeros(h: str, width: int, p: int) -> str:
    """Leading zeros among the bits below the bucket index, at most ``width - p``."""
    return f"({width - p} - {bit_length(rest_of(h, width, p))})"


def rank_of(h: str, width: int, p: int) -> str:
    return f"CAST({leading_zeros(h, width, p)} + 1 AS TINYINT)"


def inverse_power(rank: str) -> str:
    """``2 ** -rank`` (exact in a double)."""
    return f"power(2.0D, -CAST({rank} AS INT))"


def lane_is_valid(keep: str, lane: str) -> str:
    """True when all four bytes of a lane are marked in the 64-bit byte mask."""
    return f"((shiftrightunsigned({keep}, {lane} * {KEY_BYTES}) & 15L) = 15L)"


def keep_to_length(keep: str) -> str:
    """Valid bytes of a line, from its contiguous byte mask."""
    return f"bit_count({keep})"


def length_to_keep(length: str) -> str:
    """Contiguous byte mask for ``length`` bytes; 0 or anything above 63 means a full line."""
    return (
        f"(CASE WHEN {length} BETWEEN 1 AND 62 THEN shiftleft(1L, CAST({length} AS INT)) - 1L"
        f" WHEN {length} = 63 THEN {bits((1 << 63) - 1)} ELSE -1L END)"
    )


def keys_in_line(keep: str) -> str:
    return f"CAST(shiftright(bit_count({keep}), {KEY_SHIFT}) AS BIGINT)"


def is_not_empty(length: str) -> str:
    return f"({length} <> 0)"


def tuples_in_packet(length: str) -> str:
    """Whole keys in a packet of ``length`` bytes; one to three trailing bytes are not counted."""
    return f"shiftright(CAST({length} AS BIGINT), {KEY_SHIFT})"


def error_percent(estimate: str, exact: str) -> str:
    return f"(100.0D * ({estimate} / CAST({exact} AS DOUBLE) - 1.0D))"


def error_bound_percent(p: int) -> float:
    """One standard error of a sketch with ``2 ** p`` registers, in percent."""
    return 100.0 * (1.04 / float(1 << p) ** 0.5)
