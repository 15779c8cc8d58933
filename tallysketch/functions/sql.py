"""The same expressions callable from SQL text, as Spark SQL functions (inlined into the plan, no Python at run time)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.estimate import ALPHA_CORRECTION, ALPHA_NUMERATOR, SMALL_RANGE_FACTOR
from ..operators.sketch import Sketch
from .hashes import KEY_LENGTH, MURMUR3_C1, MURMUR3_C2, MURMUR3_SEED, murmur3_32, u32_key
from .u64 import FMIX_C1, FMIX_C2, add64, bits, mul64, rotl64, xorshift


def _definitions() -> list[tuple[str, str, str]]:
    seed = bits(MURMUR3_SEED ^ KEY_LENGTH)
    words = f"tally_fmix64(h1), tally_fmix64(tally_add64(h1, {seed}))"
    mixed = mul64(rotl64("k", 31), MURMUR3_C2)
    state = f"tally_add64(tally_scramble({mul64('tally_u32(key)', MURMUR3_C1, narrow=True)}) ^ {seed}, {seed})"
    return [
        ("tally_u32(key BIGINT)", "BIGINT", f"CASE WHEN key IS NOT NULL THEN {u32_key('key')} END"),
        ("tally_add64(a BIGINT, b BIGINT)", "BIGINT", add64("a", "b")),
        ("tally_scramble(k BIGINT)", "BIGINT", mixed),
        ("tally_fmix_first(a BIGINT)", "BIGINT", mul64(xorshift("a", 33), FMIX_C1)),
        ("tally_fmix_second(a BIGINT)", "BIGINT", mul64(xorshift("a", 33), FMIX_C2)),
        ("tally_fmix_third(a BIGINT)", "BIGINT", xorshift("a", 33)),
        ("tally_fmix64(a BIGINT)", "BIGINT", "tally_fmix_third(tally_fmix_second(tally_fmix_first(a)))"),
        ("tally_mix_first(h1 BIGINT)", "BIGINT", f"tally_add64({words})"),
        ("tally_mix_second(h1 BIGINT)", "BIGINT",
         f"tally_add64(tally_mix_first(h1), tally_fmix64(tally_add64(h1, {seed})))"),
        ("tally_murmur3_32(key BIGINT)", "BIGINT", f"CASE WHEN key IS NOT NULL THEN {murmur3_32('tally_u32(key)')} END"),
        ("tally_murmur3_64(key BIGINT)", "BIGINT", f"tally_mix_second({state})"),
        ("tally_murmur3_64_h1(key BIGINT)", "BIGINT", f"tally_mix_first({state})"),
        ("tally_bucket(h BIGINT, width INT, p INT)", "INT", "CAST(shiftrightunsigned(h, width - p) AS INT)"),
        ("tally_rank(h BIGINT, width INT, p INT)", "TINYINT",
         "CAST(width - p + 1 - CASE WHEN (h & (shiftleft(1L, width - p) - 1)) = 0 THEN 0"
         " ELSE length(bin(h & (shiftleft(1L, width - p) - 1))) END AS TINYINT)"),
        ("tally_estimate(nonempty BIGINT, rank_sum DOUBLE, p INT)", "DOUBLE",
         "tally_refine(shiftleft(1L, p), shiftleft(1L, p) - nonempty, rank_sum)"),
    ]


_REFINE = (
    "tally_refine(m BIGINT, zeros BIGINT, rank_sum DOUBLE)", "DOUBLE",
    f"CASE WHEN ({ALPHA_NUMERATOR}D * m / (m + {ALPHA_CORRECTION}D)) * m * m / (zeros + coalesce(rank_sum, 0D))"
    f" <= {SMALL_RANGE_FACTOR}D * m AND zeros > 0 THEN m * ln(CAST(m AS DOUBLE) / nullif(zeros, 0))"
    f" ELSE ({ALPHA_NUMERATOR}D * m / (m + {ALPHA_CORRECTION}D)) * m * m / (zeros + coalesce(rank_sum, 0D)) END",
)


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the session's ``tally_*`` SQL functions and return their names.

    An approximate distinct count in SQL: take ``min(h)`` per ``tally_bucket(h, W, p)`` (within a bucket the smallest
    hash has the largest rank, so nothing but the hash is computed per row), its ``tally_rank(min(h), W, p)``, count the
    registers of each rank, and give ``tally_estimate(sum(n), sum(n * power(2, -rank)), p)`` over those counts.
    """
    definitions = _definitions()
    for signature, returns, body in [*definitions[:-1], _REFINE, definitions[-1]]:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {returns} RETURN {body}")
    return [signature.split("(")[0] for signature, _, _ in [*definitions, _REFINE]]


def register_view(sketch: Sketch, name: str) -> DataFrame:
    """Expose a sketch's register table to SQL as a temporary view."""
    table = sketch.table()
    table.createOrReplaceTempView(name)
    return table
