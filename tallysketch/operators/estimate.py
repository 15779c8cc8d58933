"""From registers to an estimate with a known error."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.u64 import step
from .registers import MIN_P, register_count

# Fixed values of the estimator.
ALPHA_NUMERATOR = 0.7213
ALPHA_CORRECTION = 1.079
SMALL_RANGE_FACTOR = 2.5
LARGE_RANGE_START = 143165576.6
TWO_POWER_32 = 4294967296.0
HW32_WIDTH = 36

# The harmonic sum is kept as integers: word i counts ranks 31*i+1 .. 31*(i+1) in units of 2**-(31*(i+1)).  Integer sums
# do not depend on the order rows arrive in, so the same registers always give the same double.
WORD_BITS = 31
WORDS = 5


def alpha(p: int) -> float:
    m = register_count(p)
    return (ALPHA_NUMERATOR * m) / (m + ALPHA_CORRECTION)


def words_for(width: int | None) -> int:
    """Words needed for the ranks of a ``width``-bit hash (``None``: any hash)."""
    return WORDS if width is None else -(-(width - MIN_P + 1) // WORD_BITS)


def rank_word(rank: str, word: int) -> str:
    """The share of one register in word ``word`` of the harmonic sum (0 for an empty register)."""
    low, high = WORD_BITS * word, WORD_BITS * (word + 1)
    return f"(CASE WHEN {rank} > {low} AND {rank} <= {high} THEN shiftleft(1L, {high} - {rank}) ELSE 0L END)"


def harmonic_sum(zeros: str, words: Sequence[str]) -> str:
    terms = [f"CAST({zeros} AS DOUBLE)"]
    terms += [f"CAST({word} AS DOUBLE) * {2.0 ** -(WORD_BITS * (i + 1))!r}D" for i, word in enumerate(words)]
    return f"({' + '.join(terms)})"


def raw_estimate(harmonic: str, p: int) -> str:
    m = register_count(p)
    return f"({alpha(p) * m * m!r}D / {harmonic})"


def linear_count(zeros: str, p: int) -> str:
    m = float(register_count(p))
    return f"({m!r}D * ln({m!r}D / nullif({zeros}, 0)))"


def refine(raw: str, zeros: str, p: int, large_range: str = "none") -> str:
    """Small-range correction, and with ``large_range='hw32'`` the 32-bit large-range one.

    A raw value of 2**32 and more says that every 32-bit hash has been seen: the corrected estimate is infinite.
    """
    if large_range not in ("none", "hw32"):
        raise ValueError(f"large_range must be 'none' or 'hw32', got {large_range!r}")
    limit = f"{SMALL_RANGE_FACTOR * register_count(p)!r}D"
    branches = f"WHEN {raw} <= {limit} AND {zeros} > 0 THEN {linear_count(zeros, p)}"
    if large_range == "hw32":
        folded = f"-{TWO_POWER_32!r}D * ln(1.0D - {raw} / {TWO_POWER_32!r}D)"
        branches += f" WHEN {raw} >= {TWO_POWER_32!r}D THEN CAST('Infinity' AS DOUBLE)"
        branches += f" WHEN {raw} > {limit} AND {raw} > {LARGE_RANGE_START!r}D THEN {folded}"
    return f"(CASE {branches} ELSE {raw} END)"


def finish(sums: DataFrame, p: int, words: int, by: Sequence[str] = (), large_range: str = "none") -> DataFrame:
    """Finish rows ``(by..., nonempty, word0..)`` into ``(by..., estimate, zeros, harmonic, raw)``."""
    names = [f"word{i}" for i in range(words)]
    with_zeros = step(sums, zeros=f"{register_count(p)}L - nonempty")
    summed = step(with_zeros, harmonic=harmonic_sum("zeros", names))
    raw = step(summed, raw=raw_estimate("harmonic", p))
    return raw.select(
        *by, F.expr(refine("raw", "zeros", p, large_range)).alias("estimate"), "zeros", "harmonic", "raw"
    )


def register_sums(words: int) -> list[Column]:
    sums = [f"coalesce(sum({rank_word('rank', i)}), 0L) AS word{i}" for i in range(words)]
    return [F.expr(text) for text in ["count_if(rank > 0) AS nonempty", *sums]]


def estimate_registers(
    registers: DataFrame, p: int, width: int | None = None, by: Sequence[str] = (), large_range: str = "none"
) -> DataFrame:
    """Distinct-count estimate per group: ``(by..., estimate, zeros, harmonic, raw)``; no input rows give 0.0.

    ``large_range='hw32'`` is for sketches of 32-bit hashes, and needs the ``width`` to be given.
    """
    if large_range == "hw32" and (width is None or width >= HW32_WIDTH):
        raise ValueError(f"large_range='hw32' needs a hash of fewer than {HW32_WIDTH} bits, got {width}")
    words = words_for(width)
    sums = registers.groupBy(*by).agg(*register_sums(words))
    return finish(sums, p, words, by, large_range)


def standard_error(p: int) -> float:
    """Relative standard error of a sketch with ``2**p`` registers."""
    return 1.04 / math.sqrt(register_count(p))
