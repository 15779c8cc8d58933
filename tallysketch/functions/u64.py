"""Wrapping unsigned 64-bit arithmetic on BIGINT columns, as SQL expression text for ``expr`` and ``selectExpr``.

Spark has no unsigned type and, with ANSI mode on, ``+`` and ``*`` raise on overflow.  These expressions keep every
partial result inside the signed range, so they are exact and stay inside whole-stage code generation.  Callers that
chain several steps should give each its own projection (see ``hashes.py``): an argument may appear many times in the
result.  Text rather than ``Column`` objects, because building long expressions one call at a time is slow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK32 = (1 << 32) - 1
MASK62 = (1 << 62) - 1
MASK64 = (1 << 64) - 1

# Fixed values of the 64-bit finalizer.
FMIX_C1 = 0xFF51AFD7ED558CCD
FMIX_C2 = 0xC4CEB9FE1A85EC53


def bits(value: int) -> str:
    """The low 64 bits of ``value`` as a BIGINT literal."""
    value &= MASK64
    return f"({value - (1 << 64) if value >> 63 else value}L)"


def low32(a: str) -> str:
    return f"({a} & {bits(MASK32)})"


def high32(a: str) -> str:
    return f"shiftrightunsigned({a}, 32)"


def rotl64(a: str, r: int) -> str:
    return f"(shiftleft({a}, {r}) | shiftrightunsigned({a}, {64 - r}))"


def rotl32(a: str, r: int) -> str:
    """Rotate a 32-bit value held zero-extended in a BIGINT."""
    return f"({low32(f'shiftleft({a}, {r})')} | shiftrightunsigned({a}, {32 - r}))"


def xorshift(a: str, r: int) -> str:
    return f"({a} ^ shiftrightunsigned({a}, {r}))"


def add64(a: str, b: str) -> str:
    """``(a + b) mod 2**64``: add the low 62 bits, then carry into the top two."""
    low = f"(({a} & {bits(MASK62)}) + ({b} & {bits(MASK62)}))"
    top = " + ".join(f"shiftrightunsigned({x}, 62)" for x in (a, b, low))
    return f"(shiftleft({top}, 62) | ({low} & {bits(MASK62)}))"


def mul64(a: str, k: int, *, narrow: bool = False) -> str:
    """``(a * k) mod 2**64`` for a constant ``k``; ``narrow`` promises ``0 <= a < 2**32``.

    A 32-bit half times a 31-bit constant fits 63 bits, so each half of ``k`` is used without its top bit and that bit
    is added back as a shift.
    """
    k_low, k_high = k & MASK32, (k >> 32) & MASK32
    short_low, short_high = bits(k_low & 0x7FFFFFFF), bits(k_high & 0x7FFFFFFF)
    a_low = a if narrow else low32(a)
    top_of_low = f"shiftleft({a_low} & 1L, 31)"

    low, high = low32(f"({a_low} * {short_low})"), [high32(f"({a_low} * {short_low})")]
    if k_low >> 31:
        low = f"({low} + {top_of_low})"
        high += [f"shiftrightunsigned({a_low}, 1)", high32(low)]
    high.append(low32(f"({a_low} * {short_high})"))
    if k_high >> 31:
        high.append(top_of_low)
    if not narrow:
        a_high = high32(a)
        high.append(low32(f"({a_high} * {short_low})"))
        if k_low >> 31:
            high.append(f"shiftleft({a_high} & 1L, 31)")
    return f"(shiftleft({' + '.join(high)}, 32) | {low32(low)})"


def step(df: DataFrame, **columns: str) -> DataFrame:
    """One projection that adds or replaces columns by expression text."""
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})


def fmix64(df: DataFrame, *names: str) -> DataFrame:
    """Apply the 64-bit finalizer to columns in place, one projection per multiplication."""
    for k in (FMIX_C1, FMIX_C2):
        df = step(df, **{n: mul64(xorshift(n, 33), k) for n in names})
    return step(df, **{n: xorshift(n, 33) for n in names})
