"""Sketch, estimate, quality and ordering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sql import register_sql_functions, register_view
from ..functions.tables import register_table_functions
from ..operators.bitmap import build_bitmaps, count_bitmaps, merge_bitmaps
from ..operators.cumulative import checkpoints, cumulative_estimates
from ..operators.estimate import estimate_registers
from ..operators.packed import estimate_packed, merge_packed, pack_registers
from ..operators.quality import error_report, exact_distinct
from ..operators.registers import build_registers, dense_registers, merge_registers, rank_histogram, zero_count
from ..operators.sketch import Sketch, approx_distinct
from ..sources.generators import uniform_over
from ..sources.sinks import write_error_table, write_result
from ..sources.tables import read_table, scan_keys
from ..storage import new_folder
from . import sqltext as q
from .catalog import query, rounded
from .error_curve import curve_over
from .measured_run import measure, run_counters

M32 = q.murmur3_32()
WORDS = q.murmur3_words()
SIP = q.sip_variant()
HASH_SQL = {
    "murmur3_32": (M32, "h", 32), "murmur3_64": (WORDS, "h2", 64), "murmur3_64_h1": (WORDS, "h1", 64), "sip_variant": (SIP, "h", 64),
}


def registers_sql(table, column, hash_="murmur3_32", p=14, by="", rows=None):
    ctes, h, width = HASH_SQL[hash_]
    rows = rows or f"(SELECT {by + ', ' if by else ''}{column} AS key FROM {table})"
    return [q.distinct_keys(table, column), ctes, q.registers(rows, width, p, by, h)]


ESTIMATE = "round(estimate, 6) AS estimate"
REGISTERS = "SELECT bucket, CAST(rank AS TINYINT) AS rank FROM regs"


def add_registers(name, table, column, hash_, p=14):
    query(q.with_(*registers_sql(table, column, hash_, p), select=REGISTERS), name)(
        lambda spark, d: build_registers(scan_keys(spark, d, table, column), "key", p, hash_))


add_registers("a1_registers_m32_orderkey", "lineitem", "l_orderkey", "murmur3_32")
add_registers("a1_registers_m64_partkey", "lineitem", "l_partkey", "murmur3_64")
add_registers("a1_registers_sip_custkey", "orders", "o_custkey", "sip_variant", 12)


@query(q.with_(
    q.distinct_keys("orders", "o_custkey"), WORDS,
    f"""parts AS (SELECT key, CAST({q.shift_right('h2', 60)} AS INTEGER) AS bucket,
      h2 % {q.wide(1 << 60)} AS hi, h1 AS lo FROM hashed)""",
    select=f"""SELECT bucket, CAST(max(CASE WHEN hi > 0 THEN 60 - {q.significant_bits('hi')} + 1
      ELSE 124 - {q.significant_bits('lo')} + 1 END) AS TINYINT) AS rank FROM parts GROUP BY bucket""",
))
def a1_registers_h128_custkey(spark, folder):
    return build_registers(scan_keys(spark, folder, "orders", "o_custkey"), "key", 4, "murmur3_128")


def add_estimate(name, table, column, hash_, p=14):
    sql = q.with_(*registers_sql(table, column, hash_, p), q.estimate("regs", p),
                  select=f"SELECT {ESTIMATE}, zeros, round(harmonic, 6) AS harmonic, round(raw, 6) AS raw FROM est")

    def run(spark, folder):
        result = approx_distinct(scan_keys(spark, folder, table, column), "key", p, hash_)
        return result.select(
            rounded("estimate").alias("estimate"), "zeros", rounded("harmonic").alias("harmonic"), rounded("raw").alias("raw"))

    query(sql, name)(run)


add_estimate("a9_estimate_m32_orderkey", "lineitem", "l_orderkey", "murmur3_32")
add_estimate("a9_estimate_m32_partkey", "lineitem", "l_partkey", "murmur3_32")
add_estimate("a9_estimate_m32_suppkey", "lineitem", "l_suppkey", "murmur3_32")
add_estimate("a9_estimate_m32_custkey", "orders", "o_custkey", "murmur3_32")
add_estimate("a9_estimate_m64_orderkey", "lineitem", "l_orderkey", "murmur3_64")
add_estimate("a9_estimate_sip_custkey", "orders", "o_custkey", "sip_variant")
add_estimate("a10_estimate_h1_userid_p16", "events", "user_id", "murmur3_64_h1", 16)
add_estimate("a6_raw_estimate_p4", "lineitem", "l_orderkey", "murmur3_64", 4)
add_estimate("a7_linear_counting_p16", "lineitem", "l_orderkey", "murmur3_64_h1", 16)


@query(q.with_(*registers_sql("lineitem", "l_orderkey"), select=REGISTERS))
def a2_merge_halves(spark, folder):
    """Odd and even line numbers sketched apart, then merged."""
    lines = read_table(spark, folder, "lineitem")
    odd = F.coalesce(F.col("l_linenumber") % 2 == 1, F.lit(False))
    halves = [Sketch.build(lines.where(half), "l_orderkey") for half in (~odd, odd)]
    return halves[0].merge(halves[1]).registers


@query(q.with_(*registers_sql("lineitem", "l_orderkey"), select=REGISTERS))
def a3_lane_maximum(spark, folder):
    """One sketch per line number, then the largest rank over all of them."""
    lanes = Sketch.build(read_table(spark, folder, "lineitem"), "l_orderkey", by=["l_linenumber"])
    return lanes.roll_up().registers


@query(q.with_(*registers_sql("lineitem", "l_partkey", by="status",
                              rows="(SELECT l_linestatus AS status, l_partkey AS key FROM lineitem)"),
               select="SELECT status AS l_linestatus, CAST(16384 - count(*) AS BIGINT) AS zeros FROM regs GROUP BY 1"))
def a4_zero_count(spark, folder):
    registers = build_registers(read_table(spark, folder, "lineitem"), "l_partkey", by=["l_linestatus"])
    return zero_count(registers, 14, ["l_linestatus"])


@query(q.with_(*registers_sql("lineitem", "l_orderkey", "murmur3_64"), select="SELECT rank, count(*) AS registers FROM regs GROUP BY rank"))
def a5_rank_histogram(spark, folder):
    return rank_histogram(build_registers(scan_keys(spark, folder, "lineitem", "l_orderkey"), "key", 14, "murmur3_64"))


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS exact FROM lineitem GROUP BY 1")
def a11_exact_distinct(spark, folder):
    return exact_distinct(read_table(spark, folder, "lineitem"), "l_orderkey", ["l_returnflag"])


@query(q.with_(*registers_sql("lineitem", "l_orderkey"),
               select="SELECT (SELECT count(*) FROM lineitem) AS consumed, (SELECT count(*) FROM regs) AS produced"))
def a12_run_counters(spark, folder):
    counters = run_counters(read_table(spark, folder, "lineitem"), "l_orderkey")
    return spark.createDataFrame([(counters.consumed, counters.produced)], "consumed BIGINT, produced BIGINT")


GROUP_SQL = [*registers_sql("lineitem", "l_orderkey", by="l_returnflag"), q.estimate("regs", 14, "l_returnflag")]


@query(q.with_(*GROUP_SQL, select=f"SELECT l_returnflag, {ESTIMATE} FROM est"))
def a15_estimate_by_returnflag(spark, folder):
    estimates = approx_distinct(read_table(spark, folder, "lineitem"), "l_orderkey", by=["l_returnflag"])
    return estimates.select("l_returnflag", rounded("estimate").alias("estimate"))


PARTS_SQL = registers_sql("lineitem", "l_partkey", by="l_orderkey", p=8,
                          rows="(SELECT l_orderkey, l_partkey AS key FROM lineitem)")


@query(q.with_(*PARTS_SQL, q.estimate("regs", 8, "l_orderkey"), select=f"SELECT l_orderkey, {ESTIMATE} FROM est"))
def a15_estimate_by_order(spark, folder):
    """Very many small groups."""
    estimates = approx_distinct(read_table(spark, folder, "lineitem"), "l_partkey", 8, by=["l_orderkey"])
    return estimates.select("l_orderkey", rounded("estimate").alias("estimate"))


DAILY = "(SELECT CAST(ts AS DATE) AS day, event_type, user_id AS key FROM events)"


def daily_sketch(spark, folder):
    events = read_table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    return Sketch.build(events, "user_id", by=["day", "event_type"])


@query(q.with_(*registers_sql("events", "user_id", by="event_type", rows=DAILY), q.estimate("regs", 14, "event_type"),
               select=f"SELECT event_type, {ESTIMATE} FROM est"))
def a16_saved_rollup_by_type(spark, folder):
    """Daily sketches are stored partitioned by day, reloaded, and rolled up over the days."""
    path = new_folder(spark, "daily")
    daily_sketch(spark, folder).save(path, partition_by=["day"])
    saved = Sketch.load(spark, path, by=["day", "event_type"])
    return saved.roll_up(["event_type"]).estimate().select("event_type", rounded("estimate").alias("estimate"))


TEXT_GROUPS = """CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '' WHEN event_id % 5 = 2 THEN '007'
 WHEN event_id % 5 = 3 THEN '7' ELSE event_type END"""


@query(q.with_(*registers_sql("events", "user_id", by="place", rows=f"(SELECT {TEXT_GROUPS} AS place, user_id AS key FROM events)"),
               q.estimate("regs", 14, "place"), select=f"SELECT place, {ESTIMATE} FROM est"))
def a16_saved_text_groups(spark, folder):
    """Groups that folder names alone would confuse, stored partitioned and reloaded: NULL, empty, '007' and '7'."""
    path = new_folder(spark, "places")
    events = read_table(spark, folder, "events").withColumn("place", F.expr(TEXT_GROUPS))
    Sketch.build(events, "user_id", by=["place"]).save(path, partition_by=["place"])
    return Sketch.load(spark, path).estimate().select("place", rounded("estimate").alias("estimate"))


FEW_KEYS = "CASE WHEN event_type = 'error' THEN NULL ELSE user_id END"


@query(q.with_(*registers_sql("events", "user_id", by="event_type",
                              rows="(SELECT event_type, user_id AS key FROM events WHERE event_type <> 'error')"),
               q.estimate("regs", 14, "event_type"),
               select="""SELECT event_type, count(DISTINCT CASE WHEN event_type <> 'error' THEN user_id END) AS exact,
  coalesce(round(any_value(estimate), 6), 0) AS estimate FROM events LEFT JOIN est USING (event_type) GROUP BY event_type"""))
def a15_groups_without_keys(spark, folder):
    """A group whose keys are all NULL stays, with an estimate of 0."""
    events = read_table(spark, folder, "events").withColumn("key", F.expr(FEW_KEYS))
    return error_report(events, "key", by=["event_type"]).select(
        "event_type", "exact", rounded("estimate").alias("estimate"))


@query(q.with_(*registers_sql("events", "user_id", by="event_type"), q.estimate("regs", 14, "event_type"),
               "total AS (SELECT bucket, max(rank) AS rank FROM regs GROUP BY bucket)", q.estimate("total", 14, name="whole"),
               select="""SELECT e.event_type, 14 AS p, 'murmur3_32' AS hash, 0.0e0 AS estimate, count(*) AS rows,
  count(user_id) AS keys, coalesce(round(any_value(est.estimate), 6), 0) AS merged, 'type' AS level
FROM events AS e LEFT JOIN est ON e.event_type IS NOT DISTINCT FROM est.event_type GROUP BY e.event_type
UNION ALL SELECT NULL, 14, 'murmur3_32', 0.0e0, count(*), count(user_id), (SELECT round(estimate, 6) FROM whole), 'total' FROM events"""))
def x1_empty_sketch(spark, folder):
    """Sketches of groups that have rows but no key, stored and reloaded: estimates of 0, by group and rolled up, and a union
    with the sketches of the users that estimates these."""
    path = new_folder(spark, "empty")
    events = read_table(spark, folder, "events")
    no_keys = events.select("event_type", F.lit(None).cast("bigint").alias("user_id"))
    Sketch.build(no_keys, "user_id", by=["event_type"]).save(path, partition_by=["event_type"])
    users = Sketch.build(events, "user_id", by=["event_type"])

    def level(name, by):
        saved = Sketch.load(spark, path, by)
        union = saved.merge(users.roll_up(by)).estimate()
        counts = events.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count("user_id").alias("keys"))
        # Side by side through a grouping, where a join would lose the group NULL.
        parts = saved.estimate().select(*by, "estimate").unionByName(counts, True).unionByName(
            union.select(*by, rounded("estimate").alias("merged")), True)
        return parts.groupBy(*by).agg(*[F.max(c).alias(c) for c in ("estimate", "rows", "keys", "merged")]).select(
            (F.col(by[0]) if by else F.lit(None)).cast("string").alias("event_type"), F.lit(saved.p).alias("p"),
            F.lit(saved.hash).alias("hash"), "estimate", "rows", "keys", "merged", F.lit(name).alias("level"))

    return level("type", ["event_type"]).unionByName(level("total", []))


@query(q.with_(*registers_sql("events", "user_id", rows=DAILY), q.estimate("regs", 14), select=f"SELECT {ESTIMATE} FROM est"))
def a16_rollup_daily_to_total(spark, folder):
    return daily_sketch(spark, folder).roll_up().estimate().select(rounded("estimate").alias("estimate"))


@query(q.with_(*registers_sql("events", "user_id", by="event_type", rows=DAILY), q.estimate("regs", 14, "event_type"),
               select=f"SELECT event_type, {ESTIMATE}, zeros FROM est"))
def a16_packed_rollup(spark, folder):
    """Daily sketches stored as one binary each, and rolled up over the days from the binaries alone."""
    path = new_folder(spark, "packed")
    pack_registers(daily_sketch(spark, folder).registers, 14, ["day", "event_type"]).write.parquet(path)
    total = merge_packed(spark.read.parquet(path), p=14, by=["event_type"])
    return estimate_packed(total, 14, "murmur3_32", ["event_type"]).select(
        "event_type", rounded("estimate").alias("estimate"), "zeros")


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type, user_id FROM events)
SELECT 'day' AS level, CAST(day AS VARCHAR) AS name, count(DISTINCT user_id) AS exact FROM e GROUP BY day
UNION ALL SELECT 'type', event_type, count(DISTINCT user_id) FROM e GROUP BY event_type
UNION ALL SELECT 'total', NULL, count(DISTINCT user_id) FROM e""")
def a11_bitmap_rollup(spark, folder):
    """Exact counts by day, by type and in total, all from one stored table of bitmaps."""
    path = new_folder(spark, "bitmaps")
    events = read_table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    build_bitmaps(events, "user_id", ["day", "event_type"]).write.parquet(path)
    stored = spark.read.parquet(path)

    def level(name, column):
        by = [column] if column else []
        counts = count_bitmaps(merge_bitmaps(stored, by=by), by)
        return counts.select(
            F.lit(name).alias("level"), (F.col(column) if column else F.lit(None)).cast("string").alias("name"), "exact")

    return level("day", "day").unionByName(level("type", "event_type")).unionByName(level("total", None))


@query(q.with_(
    "k AS MATERIALIZED (SELECT DISTINCT l_orderkey * 1000000007 AS key FROM lineitem)", q.xxhash64(),
    q.registers("(SELECT l_orderkey * 1000000007 AS key FROM lineitem)", 64, 14), q.estimate("regs", 14),
    select=f"SELECT {ESTIMATE} FROM est",
))
def a17_wide_keys(spark, folder):
    """64-bit keys."""
    keys = read_table(spark, folder, "lineitem").select((F.col("l_orderkey") * 1000000007).alias("key"))
    return approx_distinct(keys, "key", 14, "xxhash64").select(rounded("estimate").alias("estimate"))


@query("SELECT lang, count(DISTINCT text) AS exact, true AS within_three_errors FROM documents GROUP BY lang")
def a17_text_keys(spark, folder):
    """Whole texts as keys, checked against the exact count."""
    report = error_report(read_table(spark, folder, "documents"), "text", hash="xxhash64", by=["lang"])
    return report.select("lang", "exact", (F.abs("error_pct") <= 3 * F.col("bound_pct")).alias("within_three_errors"))


@query(q.with_(*registers_sql("lineitem", "l_orderkey"), q.estimate("regs", 14),
               select="""SELECT exact, round(estimate, 6) AS estimate, round(100.0e0 * (estimate / exact - 1), 6) AS error_pct,
  0.8125e0 AS bound_pct, abs(100.0e0 * (estimate / exact - 1)) > 0.8125e0 AS out_of_range
FROM est, (SELECT count(DISTINCT l_orderkey) AS exact FROM lineitem)"""))
def a9_error_report(spark, folder):
    report = error_report(scan_keys(spark, folder, "lineitem", "l_orderkey"), "key")
    return report.select("exact", rounded("estimate").alias("estimate"), rounded("error_pct").alias("error_pct"),
                         rounded("bound_pct").alias("bound_pct"), "out_of_range")


@query("""SELECT l_returnflag, count(DISTINCT l_orderkey) AS exact, true AS builtin_within_three_errors,
true AS datasketch_within_three_errors FROM lineitem GROUP BY 1""")
def a10_builtin_counts(spark, folder):
    """Spark's own sketches, for comparison: another hash and another formula, held to three standard errors."""
    flags = read_table(spark, folder, "lineitem").groupBy("l_returnflag")
    # Beside a distinct count every order key of a flag would be a group with two sketches of its own.
    sketches = flags.agg(
        F.approx_count_distinct("l_orderkey", 0.008125).alias("builtin"),
        F.hll_sketch_estimate(F.hll_sketch_agg("l_orderkey", 14)).alias("datasketch"),
    ).withColumnRenamed("l_returnflag", "__flag")
    counts = flags.agg(F.countDistinct("l_orderkey").alias("exact")).join(
        sketches, F.col("l_returnflag").eqNullSafe(F.col("__flag")))
    near = {f"{c}_within_three_errors": F.abs(F.col(c) / F.col("exact") - 1) <= 3 * 0.008125 for c in ("builtin", "datasketch")}
    return counts.select("l_returnflag", "exact", *[column.alias(name) for name, column in near.items()])


# Cumulative estimates.

MILESTONES = "(SELECT CAST(ts AS DATE) AS day, user_id AS key FROM events)"


def cumulative_sql(p, by):
    """Running registers: a register of an earlier checkpoint counts at every later one."""
    return [
        f"points AS (SELECT DISTINCT {by} FROM regs)",
        f"run AS MATERIALIZED (SELECT points.{by}, bucket, max(rank) AS rank"
        f" FROM points JOIN regs ON regs.{by} <= points.{by} GROUP BY ALL)",
        q.estimate("run", p, by),
    ]


@query(q.with_(*registers_sql("events", "user_id", by="day", p=10, rows=MILESTONES), *cumulative_sql(10, "day"),
               select=f"SELECT CAST(day AS VARCHAR) AS day, {ESTIMATE}, zeros FROM est"))
def w4_cumulative_by_day(spark, folder):
    events = read_table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    estimates = cumulative_estimates(events, "user_id", "day", 10)
    return estimates.select(F.col("day").cast("string").alias("day"), rounded("estimate").alias("estimate"), "zeros")


FIRST = 1000


def curve_sql(hashes, drawn, p=12):
    """Error curve over ``drawn (draw, key)``, one row per order; the last checkpoint below the row count ends it."""
    points = f"""points AS MATERIALIZED (
  WITH RECURSIVE c(n) AS (SELECT {FIRST}::BIGINT UNION ALL
    SELECT CAST(floor(1.15478197e0 * n) AS BIGINT) FROM c
    WHERE CAST(floor(1.15478197e0 * n) AS BIGINT) < (SELECT count(*) FROM orders))
  SELECT n FROM c WHERE n < (SELECT count(*) FROM orders))"""
    ctes = [points, drawn, "k AS MATERIALIZED (SELECT DISTINCT key FROM drawn WHERE draw < (SELECT max(n) FROM points))"]
    columns = []
    done = set()
    for i, (label, name) in enumerate(hashes):
        text, h, width = HASH_SQL[name]
        table = {"murmur3_32": "m32", "murmur3_64": "words", "murmur3_64_h1": "words", "sip_variant": "sip"}[name]
        if table not in done:
            ctes.append({"m32": q.murmur3_32, "words": q.murmur3_words, "sip": q.sip_variant}[table](table))
            done.add(table)
        ctes += [
            f"marks{i} AS MATERIALIZED (SELECT key, {q.bucket(h, width, p)} AS bucket, {q.rank(h, width, p)} AS rank FROM {table})",
            f"run{i} AS MATERIALIZED (SELECT n, bucket, max(rank) AS rank FROM points JOIN drawn ON draw < n"
            f" JOIN marks{i} USING (key) GROUP BY ALL)",
            q.estimate(f"run{i}", p, "n", f"est{i}"),
        ]
        columns.append(f"round(100.0e0 * (est{i}.estimate / cardinality - 1), 6) AS {label}")
    return ctes, columns


CURVE = [("MURMUR3_32", "murmur3_32"), ("MURMUR3_64", "murmur3_64"), ("SIP", "sip_variant")]
CURVE_CTES, CURVE_COLUMNS = curve_sql(CURVE, "drawn AS MATERIALIZED (SELECT o_orderkey AS draw, o_orderkey AS key FROM orders)")
CURVE_SQL = q.with_(
    *CURVE_CTES, "truth AS (SELECT n, n AS cardinality FROM points)",
    select=f"SELECT cardinality, n AS draws, 1.625e0 AS expected, {', '.join(CURVE_COLUMNS)} FROM truth"
    " JOIN est0 USING (n) JOIN est1 USING (n) JOIN est2 USING (n)",
)


def order_series(spark, folder):
    return checkpoints(read_table(spark, folder, "orders").count(), FIRST)


def curve(spark, folder):
    """The orders' numbers 0, 1, 2, ... as keys in that order."""
    drawn = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("draw"), F.col("o_orderkey").alias("key"))
    report = curve_over(drawn, order_series(spark, folder), [label for label, _ in CURVE], 12, "draws")
    return report.select("cardinality", "draws", "expected", *[rounded(label).alias(label) for label, _ in CURVE])


@query(CURVE_SQL)
def w4_error_curve(spark, folder):
    return curve(spark, folder)


@query(CURVE_SQL)
def k3_error_table(spark, folder):
    """The curve written as a tab-separated file and read back."""
    path = new_folder(spark, "curve")
    write_error_table(curve(spark, folder), path)
    schema = "cardinality BIGINT, draws BIGINT, expected DOUBLE, " + ", ".join(f"{label} DOUBLE" for label, _ in CURVE)
    return spark.read.csv(path, schema=schema, sep="\t", header=True)


RANDOM_CTES, RANDOM_COLUMNS = curve_sql(CURVE[:1], f"""{q.xxhash64('mixed', '(SELECT o_orderkey AS key FROM orders)', ('key', '42'))},
drawn AS MATERIALIZED (SELECT key AS draw, CAST(h % {q.wide(q.TWO32)} AS BIGINT) AS key FROM mixed)""")


@query(q.with_(
    *RANDOM_CTES, "truth AS (SELECT n, count(DISTINCT key) AS cardinality FROM points JOIN drawn ON draw < n GROUP BY n)",
    select=f"SELECT cardinality, n AS draws, 1.625e0 AS expected, {RANDOM_COLUMNS[0]} FROM truth JOIN est0 USING (n)",
))
def x5_random_error_curve(spark, folder):
    """A seeded uniform draw per order against the exact number of different ones."""
    drawn = uniform_over(read_table(spark, folder, "orders"), "o_orderkey")
    report = curve_over(drawn, order_series(spark, folder), ["MURMUR3_32"], 12)
    return report.select("cardinality", "draws", "expected", rounded("MURMUR3_32").alias("MURMUR3_32"))


RUN_SQL = q.with_(
    *registers_sql("lineitem", "l_orderkey", p=16), q.estimate("regs", 16),
    select="""SELECT 'MURMUR3_32' AS hash, 16 AS p, keys, exact, round(estimate, 6) AS estimate,
  round(100.0e0 * (estimate / exact - 1), 6) AS error_pct, 0.40625e0 AS bound_pct,
  abs(100.0e0 * (estimate / exact - 1)) > 0.40625e0 AS out_of_range
  FROM est, (SELECT count(l_orderkey) AS keys, count(DISTINCT l_orderkey) AS exact FROM lineitem)""",
)


def report_columns(report):
    return report.select("hash", "p", "keys", "exact", rounded("estimate").alias("estimate"),
                         rounded("error_pct").alias("error_pct"), rounded("bound_pct").alias("bound_pct"), "out_of_range")


@query(RUN_SQL)
def k4_run_report(spark, folder):
    return report_columns(measure(scan_keys(spark, folder, "lineitem", "l_orderkey"), "key", "MURMUR3_32"))


@query(RUN_SQL)
def x4_measured_run(spark, folder):
    """The same run cut into another number of partitions."""
    keys = scan_keys(spark, folder, "lineitem", "l_orderkey").repartition(5)
    return report_columns(measure(keys, "key", "MURMUR3_32"))


@query("""SELECT 'MURMUR3_64' AS hash, count(o_custkey) AS keys, true AS timed, true AS speed_is_keys_by_time FROM orders""")
def a14_throughput(spark, folder):
    """Keys per run and its speed; times differ from run to run, so only what must hold of them is reported."""
    report = measure(scan_keys(spark, folder, "orders", "o_custkey"), "key", "MURMUR3_64")
    speed = F.abs(F.col("mb_per_s") * F.col("collection_s") * 1e6 / (4 * F.col("keys")) - 1) < 1e-9
    return report.select(
        "hash", "keys", ((F.col("collection_s") > 0) & (F.col("total_s") > 0)).alias("timed"),
        speed.alias("speed_is_keys_by_time"),
    )


@query(q.with_(*registers_sql("events", "event_id"), q.estimate("regs", 14), select=f"SELECT {ESTIMATE}, zeros FROM est"))
def s5_filled_input(spark, folder):
    """The events' numbers 0..n-1."""
    keys = scan_keys(spark, folder, "events", "event_id")
    return approx_distinct(keys, "key").select(rounded("estimate").alias("estimate"), "zeros")


@query(q.with_(*registers_sql("orders", "o_custkey", p=10), q.estimate("regs", 10),
               select=f"SELECT CAST(0 AS BIGINT) AS run_id, {ESTIMATE} FROM est"))
def k1_written_result(spark, folder):
    path = new_folder(spark, "result")
    write_result(approx_distinct(scan_keys(spark, folder, "orders", "o_custkey"), "key", 10), path)
    return spark.read.parquet(path).select("run_id", rounded("estimate").alias("estimate"))


@query(q.with_(*registers_sql("events", "user_id", p=10, by="event_type"),
               select="""SELECT t.event_type, CAST(b AS INTEGER) AS bucket, CAST(coalesce(regs.rank, 0) AS TINYINT) AS rank
FROM (SELECT DISTINCT event_type FROM events) t CROSS JOIN range(1024) AS r(b)
LEFT JOIN regs ON regs.event_type = t.event_type AND regs.bucket = b"""))
def o1_dense_registers(spark, folder):
    registers = build_registers(read_table(spark, folder, "events"), "user_id", 10, by=["event_type"])
    return dense_registers(registers, 10, ["event_type"])


@query(q.with_(*registers_sql("lineitem", "l_orderkey", by="l_shipyear", p=12,
                              rows="(SELECT year(l_shipdate) AS l_shipyear, l_orderkey AS key FROM lineitem)"),
               q.estimate("regs", 12, "l_shipyear"),
               select="""SELECT CAST(l_shipyear AS INTEGER) AS l_shipyear, exact, round(100.0e0 * (estimate / exact - 1), 6) AS error_pct
FROM est JOIN (SELECT year(l_shipdate) AS l_shipyear, count(DISTINCT l_orderkey) AS exact FROM lineitem GROUP BY 1) USING (l_shipyear)
ORDER BY exact"""))
def o2_report_by_cardinality(spark, folder):
    lines = read_table(spark, folder, "lineitem").withColumn("l_shipyear", F.year("l_shipdate"))
    report = error_report(lines, "l_orderkey", 12, by=["l_shipyear"])
    return report.select("l_shipyear", "exact", rounded("error_pct").alias("error_pct")).orderBy("exact")


BOTH = "(SELECT user_id AS key FROM events UNION ALL SELECT o_custkey FROM orders)"


@query(q.with_(
    f"k AS MATERIALIZED (SELECT DISTINCT key FROM {BOTH})", M32, q.registers(BOTH, 32, 14), q.estimate("regs", 14),
    select=f"SELECT {ESTIMATE} FROM est",
))
def u5_union_of_sketches(spark, folder):
    """Two tables sketched apart: the estimate of their union."""
    users = build_registers(scan_keys(spark, folder, "events", "user_id"), "key")
    customers = build_registers(scan_keys(spark, folder, "orders", "o_custkey"), "key")
    return estimate_registers(merge_registers(users, customers), 14, 32).select(rounded("estimate").alias("estimate"))


@query(q.with_(*registers_sql("customer", "c_custkey", "murmur3_64_h1"),
               select="SELECT 14 AS p, 'murmur3_64_h1' AS hash, bucket, CAST(rank AS TINYINT) AS rank FROM regs"))
def x1_sketch_table(spark, folder):
    return Sketch.build(scan_keys(spark, folder, "customer", "c_custkey"), "key", 14, "murmur3_64_h1").table()


@query(q.with_(*registers_sql("lineitem", "l_suppkey", "murmur3_64"), q.estimate("regs", 14), select=f"SELECT {ESTIMATE} FROM est"))
def x2_build_merge_estimate(spark, folder):
    """Three parts of the table sketched apart and merged."""
    lines = read_table(spark, folder, "lineitem")
    is_open = F.col("l_linestatus").eqNullSafe("O")
    early = F.coalesce(F.col("l_shipdate") < "1998-01-01", F.lit(False))
    parts = [lines.where(is_open & early), lines.where(is_open & ~early), lines.where(~is_open)]
    first, *others = [Sketch.build(part, "l_suppkey", 14, "murmur3_64") for part in parts]
    return first.merge(*others).estimate().select(rounded("estimate").alias("estimate"))


@query(q.with_(*GROUP_SQL, select=f"SELECT l_returnflag, {ESTIMATE} FROM est"))
def x7_sql_functions(spark, folder):
    """The whole estimate written in SQL."""
    register_sql_functions(spark)
    read_table(spark, folder, "lineitem").createOrReplaceTempView("tally_lines")
    return spark.sql("""
        WITH hashed AS (SELECT l_returnflag, tally_murmur3_32(l_orderkey) AS h FROM tally_lines),
        registers AS (SELECT l_returnflag, tally_bucket(h, 32, 14) AS bucket, min(h) AS smallest
                      FROM hashed WHERE h IS NOT NULL GROUP BY ALL),
        ranks AS (SELECT l_returnflag, tally_rank(smallest, 32, 14) AS rank FROM registers),
        counts AS (SELECT l_returnflag, rank, count(*) AS n FROM ranks GROUP BY ALL),
        sums AS (SELECT l_returnflag, sum(n) AS n, sum(n * power(2D, -rank)) AS s FROM counts GROUP BY l_returnflag)
        SELECT l_returnflag, round(tally_estimate(n, s, 14), 6) AS estimate FROM sums""")


@query(q.with_(
    q.distinct_keys("orders", "o_custkey"), WORDS,
    select=f"SELECT CAST(key AS BIGINT) AS key, {q.signed('h2')} AS h2, {q.signed('h1')} AS h1 FROM hashed",
))
def x7_sql_wide_hashes(spark, folder):
    register_sql_functions(spark)
    read_table(spark, folder, "orders").createOrReplaceTempView("tally_orders")
    return spark.sql("""SELECT key, tally_murmur3_64(key) AS h2, tally_murmur3_64_h1(key) AS h1
                        FROM (SELECT DISTINCT o_custkey AS key FROM tally_orders)""")


@query(q.with_(*registers_sql("orders", "o_custkey"), select="SELECT rank, count(*) AS registers FROM regs GROUP BY rank"))
def x7_register_view(spark, folder):
    register_view(Sketch.build(scan_keys(spark, folder, "orders", "o_custkey"), "key"), "tally_registers")
    return spark.sql("SELECT rank, count(*) AS registers FROM tally_registers GROUP BY rank")


@query(q.with_(*registers_sql("lineitem", "l_orderkey", by="l_returnflag"), q.estimate("regs", 14, "l_returnflag"),
               select=f"SELECT l_returnflag, {ESTIMATE}, zeros FROM est"))
def x7_table_function(spark, folder):
    """A table function over a view of packed sketches by flag and status, in partitions that the SQL names."""
    register_table_functions(spark)
    by = ["l_returnflag", "l_linestatus"]
    lines = Sketch.build(read_table(spark, folder, "lineitem"), "l_orderkey", by=by)
    pack_registers(lines.registers, 14, by).createOrReplaceTempView("tally_line_sketches")
    return spark.sql("""SELECT l_returnflag, round(estimate, 6) AS estimate, zeros
                        FROM tally_sketch(TABLE(SELECT l_returnflag, packed FROM tally_line_sketches) PARTITION BY (l_returnflag), 14, 'estimate')""")
