"""ANSI SQL building blocks for the cross-checks: the same hashes and estimates in wide integer arithmetic.

Every function returns the text of one or more common table expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

TWO32 = 1 << 32
TWO64 = 1 << 64
WORD = f"{TWO64}::UHUGEINT"


def wide(value: int) -> str:
    return f"{value}::UHUGEINT"


def chain(name: str, source: str, keep: str, steps: Sequence[str]) -> str:
    """CTEs ``name_1 .. name_n``; every step selects ``keep`` and its own expressions from the step before."""
    parts, previous = [], source
    for i, step in enumerate(steps, 1):
        label = name if i == len(steps) else f"{name}_{i}"
        parts.append(f"{label} AS MATERIALIZED (SELECT {keep}, {step} FROM {previous})")
        previous = label
    return ",\n".join(parts)


def distinct_keys(table: str, column: str, name: str = "k") -> str:
    return f"{name} AS MATERIALIZED (SELECT DISTINCT {column} AS key FROM {table} WHERE {column} IS NOT NULL)"


def shift_right(x: str, n: int) -> str:
    return f"({x} // {wide(1 << n)})"


def rotate(x: str, r: int) -> str:
    return f"(({x} * {wide(1 << r)}) % {WORD} + {shift_right(x, 64 - r)})"


def murmur3_32(name: str = "hashed", source: str = "k") -> str:
    """``(key, h)``: 32-bit values fit products in UBIGINT."""

    def times(c: int) -> str:
        return f"(h * {c}::UBIGINT) % {TWO32}::UBIGINT AS h"

    def turn(r: int) -> str:
        return f"((h * {1 << r}::UBIGINT) % {TWO32}::UBIGINT) | (h // {1 << (32 - r)}::UBIGINT) AS h"

    def fold(n: int) -> str:
        return f"xor(h, h // {1 << n}::UBIGINT) AS h"

    return chain(name, source, "key", [
        "key::UBIGINT AS h", times(0xCC9E2D51), turn(15), times(0x1B873593), "xor(h, 42::UBIGINT) AS h", turn(13),
        f"(h * 5::UBIGINT + {0xE6546B64}::UBIGINT) % {TWO32}::UBIGINT AS h", "xor(h, 4::UBIGINT) AS h", fold(16),
        times(0x85EBCA6B), fold(13), times(0xC2B2AE35), fold(16),
    ])


def murmur3_words(name: str = "hashed", source: str = "k") -> str:
    """``(key, h1, h2)`` of the 128-bit hash."""
    seed = wide(0xBAADF00D ^ 4)

    def both(fn) -> str:
        return f"{fn('h1')} AS h1, {fn('h2')} AS h2"

    def fold(x: str) -> str:
        return f"xor({x}, {shift_right(x, 33)})"

    def times(x: str, c: int) -> str:
        return f"({x} * {wide(c)}) % {WORD}"

    return chain(name, source, "key", [
        "key::UHUGEINT AS h1",
        f"{times('h1', 0x87C37B91114253D5)} AS h1",
        f"{rotate('h1', 31)} AS h1",
        f"{times('h1', 0x4CF5AD432745937F)} AS h1",
        f"(xor(h1, {seed}) + {seed}) % {WORD} AS h1",
        f"h1, (h1 + {seed}) % {WORD} AS h2",
        both(fold), both(lambda x: times(x, 0xFF51AFD7ED558CCD)), both(fold),
        both(lambda x: times(x, 0xC4CEB9FE1A85EC53)), both(fold),
        f"(h1 + h2) % {WORD} AS h1, h2",
        f"h1, (h1 + h2) % {WORD} AS h2",
    ])


def sip_variant(name: str = "hashed", source: str = "k") -> str:
    """``(key, h)``."""
    message = f"(key::UHUGEINT + {wide(8 << 56)})"
    columns = ["v0", "v1", "v2", "v3"]

    def change(**new: str) -> str:
        return ", ".join(f"{new.get(c, c)} AS {c}" for c in columns)

    def add(x: str, y: str) -> str:
        return f"({x} + {y}) % {WORD}"

    one_round = [
        change(v0=add("v0", "v1"), v2=add("v2", "v3")),
        change(v1=f"xor({rotate('v1', 13)}, v0)", v3=f"xor({rotate('v3', 16)}, v2)"),
        change(v0=rotate("v0", 32)),
        change(v0=add("v0", "v3"), v2=add("v2", "v1")),
        change(v3=f"xor({rotate('v3', 21)}, v0)", v1=f"xor({rotate('v1', 17)}, v2)"),
        change(v2=rotate("v2", 32)),
    ]
    start = (
        f"{wide(0x736F6D6570736575)} AS v0, {wide(0x646F72616E646F6D)} AS v1, {wide(0x6C7967656E657261)} AS v2,"
        f" xor({wide(0x7465646279746573)}, {message}) AS v3"
    )
    middle = change(v0=f"xor(v0, {message})", v2=f"xor(v2, {wide(0xFF)})")
    return chain(name, source, "key", [start, *one_round * 2, middle, *one_round * 4, "xor(v0, v2) AS h"])


def xxhash64(name: str = "hashed", source: str = "k", values: Sequence[str] = ("key",), seed: int = 42) -> str:
    """``(key, h)``: XXH64 of one or more 64-bit columns, the result of each seeding the next."""
    p1, p2, p3, p4, p5 = (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    )
    steps = [f"{wide(seed)} AS h"]
    for value in values:
        word = f"(({value}::HUGEINT + {TWO64}::HUGEINT) % {TWO64}::HUGEINT)::UHUGEINT"
        steps += [
            f"(h + {wide(p5 + 8)}) % {WORD} AS h, ({word} * {wide(p2)}) % {WORD} AS k",
            f"h, {rotate('k', 31)} AS k",
            f"xor(h, (k * {wide(p1)}) % {WORD}) AS h",
            f"{rotate('h', 27)} AS h",
            f"((h * {wide(p1)}) % {WORD} + {wide(p4)}) % {WORD} AS h",
            f"xor(h, {shift_right('h', 33)}) AS h",
            f"(h * {wide(p2)}) % {WORD} AS h",
            f"xor(h, {shift_right('h', 29)}) AS h",
            f"(h * {wide(p3)}) % {WORD} AS h",
            f"xor(h, {shift_right('h', 32)}) AS h",
        ]
    return chain(name, source, "key", steps)


def signed(h: str) -> str:
    """A 64-bit word as BIGINT bits."""
    return f"CAST(CASE WHEN {h} >= {wide(1 << 63)} THEN {h}::HUGEINT - {TWO64}::HUGEINT ELSE {h}::HUGEINT END AS BIGINT)"


def bucket(h: str, width: int, p: int) -> str:
    return f"CAST({h} // {1 << (width - p)} AS INTEGER)" if width == 32 else f"CAST({shift_right(h, width - p)} AS INTEGER)"


def significant_bits(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 0 ELSE length(bin(({x})::UBIGINT)) END"


def leading_zeros(h: str, width: int, p: int) -> str:
    rest = f"({h} % {1 << (width - p)})" if width == 32 else f"({h} % {wide(1 << (width - p))})"
    return f"({width - p} - {significant_bits(rest)})"


def rank(h: str, width: int, p: int) -> str:
    return f"CAST({leading_zeros(h, width, p)} + 1 AS TINYINT)"


def registers(
    rows: str, width: int, p: int, by: str = "", h: str = "h", name: str = "regs", hashed: str = "hashed", key: str = "key"
) -> str:
    """Registers of ``rows`` (a table with ``by`` and ``key``) through the ``hashed`` table."""
    group = f"{by}, " if by else ""
    return (
        f"marks AS MATERIALIZED (SELECT key, {bucket(h, width, p)} AS bucket, {rank(h, width, p)} AS rank FROM {hashed}),\n"
        f"{name} AS MATERIALIZED (SELECT {group}bucket, max(rank) AS rank"
        f" FROM {rows} AS r JOIN marks ON r.{key} = marks.key GROUP BY {group}bucket)"
    )


def estimate(regs: str, p: int, by: str = "", name: str = "est") -> str:
    """``(by, zeros, harmonic, raw, estimate)`` from a register table."""
    m = 1 << p
    group = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    alpha = f"(0.7213e0 * {m} / ({m} + 1.079e0))"
    return (
        f"{name}_sums AS (SELECT {group}CAST({m} - count(*) AS BIGINT) AS zeros,"
        f" {m} - count(*) + coalesce(sum(power(2.0e0, -rank)), 0) AS harmonic FROM {regs}{tail}),\n"
        f"{name}_raw AS (SELECT *, {alpha} * {m} * {m} / harmonic AS raw FROM {name}_sums),\n"
        f"{name} AS (SELECT {group}zeros, harmonic, raw, CASE WHEN raw <= 2.5 * {m} AND zeros > 0"
        f" THEN {m} * ln({m}.0e0 / zeros) ELSE raw END AS estimate FROM {name}_raw)"
    )


def with_(*ctes: str, select: str, recursive: bool = False) -> str:
    keyword = "WITH RECURSIVE" if recursive else "WITH"
    return f"{keyword} " + ",\n".join(ctes) + f"\n{select}"
