"""Hash and expression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits as b
from ..functions import u64
from ..functions.hashes import MURMUR3_C2, get_hash, hash_keys, hash_name, register_hash
from ..operators.estimate import linear_count, refine
from ..operators.quality import error_report
from ..operators.registers import MAX_P, MIN_P, build_registers, rank_histogram, valid_p, zero_count
from ..sources.lines import unpack_lines
from ..sources.tables import read_table, scan_keys
from . import sqltext as q
from .catalog import LINES_SQL, PACKETS_SQL, event_lines, event_packets, query, rounded


def hashed_rows(spark, folder, table, column, hash):
    """Every row's key and its hash."""
    return hash_keys(scan_keys(spark, folder, table, column), "key", hash)


def hash_sql(table, column, ctes, value):
    return q.with_(
        q.distinct_keys(table, column), ctes,
        select=f"SELECT CAST(t.{column} AS BIGINT) AS key, {value} AS hash FROM {table} t JOIN hashed ON t.{column} = hashed.key",
    )


M32 = q.murmur3_32()
WORDS = q.murmur3_words()
HASHES = [
    ("h1_ident", "lineitem", "l_partkey", "ident", hash_sql("lineitem", "l_partkey", "hashed AS (SELECT key, key AS h FROM k)", "h")),
    ("h2_murmur3_32", "lineitem", "l_orderkey", "murmur3_32", hash_sql("lineitem", "l_orderkey", M32, "CAST(h AS BIGINT)")),
    ("h3_murmur3_64", "lineitem", "l_orderkey", "murmur3_64", hash_sql("lineitem", "l_orderkey", WORDS, q.signed("h2"))),
    ("h4_murmur3_64_h1", "lineitem", "l_partkey", "murmur3_64_h1", hash_sql("lineitem", "l_partkey", WORDS, q.signed("h1"))),
    ("h6_sip_variant", "orders", "o_custkey", "SIP", hash_sql("orders", "o_custkey", q.sip_variant(), q.signed("h"))),
    ("h7_murmur3_32_vector", "orders", "o_orderkey", "MURMUR3_32AVX", hash_sql("orders", "o_orderkey", M32, "CAST(h AS BIGINT)")),
    ("h8_murmur3_64_vector", "orders", "o_custkey", "MURMUR3_64AVX", hash_sql("orders", "o_custkey", WORDS, q.signed("h2"))),
    ("a17_xxhash64_keys", "orders", "o_custkey", "xxhash64", hash_sql("orders", "o_custkey", q.xxhash64(), q.signed("h"))),
]
for _name, _table, _column, _hash, _sql in HASHES:
    query(_sql, _name)(lambda spark, d, t=_table, c=_column, h=_hash: hashed_rows(spark, d, t, c, h))


@query(q.with_(
    q.distinct_keys("orders", "o_custkey"), WORDS,
    select=f"SELECT CAST(o_custkey AS BIGINT) AS key, {q.signed('h2')} AS hi, {q.signed('h1')} AS lo"
    " FROM orders JOIN hashed ON o_custkey = hashed.key",
))
def h5_murmur3_128(spark, folder):
    hashed = hashed_rows(spark, folder, "orders", "o_custkey", "murmur3_128")
    return hashed.select("key", F.col("hash.hi").alias("hi"), F.col("hash.lo").alias("lo"))


NAMES = ["IDENT", "SIP", "MURMUR3_32", "MURMUR3_64", "MURMUR3_32AVX", "MURMUR3_64AVX"]


@query(
    "SELECT l_linenumber - 1 AS id, CASE l_linenumber - 1 "
    + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES))
    + " ELSE '<undef>' END AS name, count(*) AS uses FROM lineitem GROUP BY ALL"
)
def h9_hash_names(spark, folder):
    ids = read_table(spark, folder, "lineitem").select((F.col("l_linenumber") - 1).alias("id"))
    return ids.select("id", hash_name(F.col("id")).alias("name")).groupBy("id", "name").agg(F.count(F.lit(1)).alias("uses"))


WIDE_KEY = f"(o_orderkey::UHUGEINT * {q.wide(1 << 40)} + o_orderkey::UHUGEINT) % {q.WORD}"


def wide_keys(spark, folder):
    """Order keys spread over 64 bits."""
    orders = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"))
    return orders.withColumn("x", F.shiftleft("key", 40).bitwiseOR(F.col("key")))


@query(f"""WITH x AS (SELECT o_orderkey AS key, {WIDE_KEY} AS x FROM orders)
SELECT key, {q.signed(q.rotate('x', 31))} AS r64,
  CAST(((key * 32768) % {q.TWO32}) | (key // 131072) AS BIGINT) AS r32 FROM x""")
def f1_rotate(spark, folder):
    x = wide_keys(spark, folder)
    return x.select("key", F.expr(u64.rotl64("x", 31)).alias("r64"), F.expr(u64.rotl32("key", 15)).alias("r32"))


@query(q.with_(
    f"x AS (SELECT o_orderkey AS key, {WIDE_KEY} AS h FROM orders)",
    q.chain("mixed", "x", "key", [
        f"xor(h, {q.shift_right('h', 33)}) AS h", f"(h * {q.wide(0xFF51AFD7ED558CCD)}) % {q.WORD} AS h",
        f"xor(h, {q.shift_right('h', 33)}) AS h", f"(h * {q.wide(0xC4CEB9FE1A85EC53)}) % {q.WORD} AS h",
        f"xor(h, {q.shift_right('h', 33)}) AS h",
    ]),
    select=f"SELECT key, {q.signed('h')} AS mixed FROM mixed",
))
def f2_fmix64(spark, folder):
    return u64.fmix64(wide_keys(spark, folder), "x").select("key", F.col("x").alias("mixed"))


@query(f"""WITH x AS (SELECT o_orderkey AS key, {WIDE_KEY} AS x FROM orders),
y AS (SELECT key, (x * {q.wide(MURMUR3_C2)}) % {q.WORD} AS c, (x * {q.wide(u64.FMIX_C1)}) % {q.WORD} AS d FROM x)
SELECT key, {q.signed('c')} AS product, {q.signed(f'((c + d) % {q.WORD})')} AS total FROM y""")
def f3_wrapping_arithmetic(spark, folder):
    x = wide_keys(spark, folder)
    x = u64.step(x, product=u64.mul64("x", MURMUR3_C2), other=u64.mul64("x", u64.FMIX_C1))
    return x.select("key", "product", F.expr(u64.add64("product", "other")).alias("total"))


def key_parts(hash_, width, p, fn, name):
    """Per distinct key, one expression over its hash."""

    def run(spark, folder):
        keys = scan_keys(spark, folder, "lineitem", "l_partkey").distinct()
        return hash_keys(keys, "key", hash_).select("key", F.expr(fn("hash", width, p)).alias(name))

    return run


def part_sql(ctes, value, name):
    return q.with_(q.distinct_keys("lineitem", "l_partkey"), ctes, select=f"SELECT CAST(key AS BIGINT) AS key, {value} AS {name} FROM hashed")


query(part_sql(M32, q.bucket("h", 32, 14), "bucket"), "f4_bucket")(key_parts("murmur3_32", 32, 14, b.bucket_of, "bucket"))
query(part_sql(M32, f"CAST({q.leading_zeros('h', 32, 14)} AS INTEGER)", "zeros"), "f5_leading_zeros")(
    key_parts("murmur3_32", 32, 14, b.leading_zeros, "zeros"))
query(part_sql(WORDS, f"CAST({q.leading_zeros('h2', 64, 4)} AS INTEGER)", "zeros"), "f6_leading_zeros_wide")(
    key_parts("MURMUR3_64AVX", 64, 4, b.leading_zeros, "zeros"))
query(part_sql(WORDS, q.rank("h1", 64, 16), "rank"), "f7_rank")(key_parts("murmur3_64_h1", 64, 16, b.rank_of, "rank"))


def m32_registers_sql(table, column, p=14, by=""):
    rows = f"(SELECT {by + ', ' if by else ''}{column} AS key FROM {table})"
    return [q.distinct_keys(table, column), M32, q.registers(rows, 32, p, by)]


@query(q.with_(*m32_registers_sql("lineitem", "l_orderkey"),
               select="SELECT rank, count(*) AS registers, power(2.0e0, -rank) AS share FROM regs GROUP BY rank"))
def f8_inverse_power(spark, folder):
    registers = build_registers(scan_keys(spark, folder, "lineitem", "l_orderkey"), "key")
    return rank_histogram(registers).withColumn("share", F.expr(b.inverse_power("rank")))


@query(q.with_(*m32_registers_sql("lineitem", "l_suppkey", by="l_returnflag"),
               select="SELECT l_returnflag, CAST(16384 - count(*) AS BIGINT) AS zeros,"
               " round(16384 * ln(16384.0e0 / (16384 - count(*))), 6) AS counted FROM regs GROUP BY l_returnflag"))
def f9_linear_count(spark, folder):
    lines = read_table(spark, folder, "lineitem")
    zeros = zero_count(build_registers(lines, "l_suppkey", by=["l_returnflag"]), 14, ["l_returnflag"])
    return zeros.select("l_returnflag", F.col("zeros").cast("bigint").alias("zeros"), rounded(F.expr(linear_count("zeros", 14))).alias("counted"))


@query(f"""WITH {LINES_SQL}, per AS (SELECT seq, count(*) AS n FROM lines GROUP BY seq)
SELECT seq, CAST(lane AS INTEGER) AS lane, lane < n AS valid FROM per, range(16) AS r(lane)""")
def f10_lane_valid(spark, folder):
    return unpack_lines(event_lines(spark, folder), ["seq"], "as_zero").select("seq", "lane", "valid")


@query(f"""WITH {LINES_SQL}, per AS (SELECT seq, 4 * count(*) AS n FROM lines GROUP BY seq)
SELECT seq, CAST(n AS INTEGER) AS bytes, CAST(power(2::HUGEINT, n) - 1 AS BIGINT) AS keep FROM per""")
def f11_mask_length(spark, folder):
    lines = event_lines(spark, folder).select("seq", F.expr(b.keep_to_length("keep")).alias("bytes"))
    return lines.withColumn("keep", F.expr(b.length_to_keep("bytes")))


# Packet lengths taken from the conversations: bytes of text, so any remainder modulo four occurs, zero included.
TURNS_SQL = "SELECT conv_id, turn, CAST(strlen(text) // 16 AS BIGINT) AS length FROM conversations"


def text_packets(spark, folder):
    turns = read_table(spark, folder, "conversations")
    return turns.select("conv_id", "turn", F.shiftright(F.octet_length("text").cast("bigint"), 4).alias("length"))


@query(f"WITH t AS ({TURNS_SQL}) SELECT * FROM t WHERE length <> 0")
def f12_nonempty_packets(spark, folder):
    return text_packets(spark, folder).where(b.is_not_empty("length"))


@query(f"WITH t AS ({TURNS_SQL}) SELECT *, length // 4 AS tuples FROM t")
def f13_packet_tuples(spark, folder):
    return text_packets(spark, folder).withColumn("tuples", F.expr(b.tuples_in_packet("length")))


@query(f"SELECT p_partkey, p_size, p_size BETWEEN {MIN_P} AND {MAX_P} AS valid FROM part")
def f14_parameter_range(spark, folder):
    return read_table(spark, folder, "part").select(
        "p_partkey", "p_size", valid_p("p_size").alias("valid"))


REPORT = [
    *m32_registers_sql("lineitem", "l_orderkey", by="l_returnflag"), q.estimate("regs", 14, "l_returnflag"),
    "truth AS (SELECT l_returnflag, count(DISTINCT l_orderkey) AS exact FROM lineitem GROUP BY l_returnflag)",
    "report AS (SELECT l_returnflag, exact, estimate, 100.0e0 * (estimate / exact - 1) AS error_pct,"
    " 100.0e0 * 1.04e0 / sqrt(16384.0e0) AS bound_pct FROM est JOIN truth USING (l_returnflag))",
]


def flag_report(spark, folder):
    return error_report(read_table(spark, folder, "lineitem"), "l_orderkey", by=["l_returnflag"])


@query(q.with_(*REPORT, select="SELECT l_returnflag, round(error_pct, 6) AS error_pct FROM report"))
def f15_error_percent(spark, folder):
    return flag_report(spark, folder).select("l_returnflag", rounded("error_pct").alias("error_pct"))


@query(q.with_(*REPORT, select="SELECT l_returnflag, round(bound_pct, 6) AS bound_pct FROM report"))
def f16_error_bound(spark, folder):
    return flag_report(spark, folder).select("l_returnflag", rounded("bound_pct").alias("bound_pct"))


@query(q.with_(*REPORT, select="SELECT l_returnflag, abs(error_pct) > bound_pct AS out_of_range FROM report"))
def f17_out_of_range(spark, folder):
    return flag_report(spark, folder).select("l_returnflag", "out_of_range")


@query("""WITH x AS (
  SELECT l_orderkey, l_linenumber, l_extendedprice * power(10.0e0, l_linenumber - 3) AS raw, l_orderkey % 3 AS zeros
  FROM lineitem)
SELECT l_orderkey, l_linenumber, round(ln(CASE WHEN raw <= 40960 AND zeros > 0 THEN 16384 * ln(16384.0e0 / zeros)
  WHEN raw > 143165576.6e0 THEN -4294967296.0e0 * ln(1 - raw / 4294967296.0e0) ELSE raw END), 9) AS log_refined FROM x""")
def a8_large_range(spark, folder):
    """The corrections as scalar functions over raw values of every size."""
    lines = read_table(spark, folder, "lineitem")
    lines = u64.step(lines, raw="l_extendedprice * power(10.0D, l_linenumber - 3)", zeros="l_orderkey % 3")
    refined = F.expr(refine("raw", "zeros", 14, "hw32"))
    return lines.select("l_orderkey", "l_linenumber", rounded(F.ln(refined), 9).alias("log_refined"))


FOLD_MULTIPLIER = 2654435761
register_hash(
    "multiplicative", 32, replace=True,
    attach=lambda df, key, out: u64.step(df, **{out: u64.low32(u64.mul64(key, FOLD_MULTIPLIER, narrow=True))}),
)
FOLDED = f"hashed AS (SELECT key, (key::UBIGINT * {FOLD_MULTIPLIER}::UBIGINT) % {q.TWO32}::UBIGINT AS h FROM k)"


@query(q.with_(
    q.distinct_keys("orders", "o_custkey"), FOLDED, q.registers("(SELECT o_custkey AS key FROM orders)", 32, 12),
    q.estimate("regs", 12), select="SELECT zeros, round(estimate, 6) AS estimate FROM est",
))
def x3_custom_hash(spark, folder):
    """A user-registered hash goes through the same sketch."""
    from ..operators.sketch import approx_distinct

    hash_ = get_hash("multiplicative")
    return approx_distinct(scan_keys(spark, folder, "orders", "o_custkey"), "key", 12, hash_).select(
        "zeros", rounded("estimate").alias("estimate"))
