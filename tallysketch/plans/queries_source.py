"""Source, sink, window and routing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.reach import reaching_windows
from ..operators.routing import merge_by_origin, merge_fair, merge_priority, split_packets
from ..operators.running import levels_for, running
from ..operators.scan import scan
from ..operators.windows import count_windows, estimate_windows, place_packets, run_ids, running_tuples
from ..sources.extents import read_extent, write_extent
from ..sources.generators import generated_over, uniform_over
from ..sources.lines import count_lane_keys, unpack_lines
from ..sources.packets import read_packets
from ..sources.tables import read_table, scan_keys
from ..storage import new_folder
from . import sqltext as q
from .catalog import (
    KEYS_PER_PACKET, LINES_SQL, LINES_PER_RUN, PACKETS_SQL, event_lines, event_packets, query, rounded,
)
from .flows import estimate_extent, estimate_runs, tee_windows

WORDS = q.murmur3_words()


@query("SELECT CAST(l_orderkey AS BIGINT) AS key FROM lineitem")
def s1_scan_keys(spark, folder):
    return scan_keys(spark, folder, "lineitem", "l_orderkey")


@query("SELECT CAST((l_orderkey * 2654435761) % 4294967296 AS BIGINT) AS key FROM lineitem")
def s2_generated_keys(spark, folder):
    """A user generator pulled once per line item, at the position its order has."""
    lines = read_table(spark, folder, "lineitem")
    return generated_over(lines, "l_orderkey", lambda i: (i * 2654435761) % 4294967296)


@query("SELECT event_id AS key, CAST(2 AS BIGINT) AS passes FROM events")
def s3_naturals_reset(spark, folder):
    """The events' numbers 0, 1, 2, ... read twice: every reading starts over."""
    keys = scan_keys(spark, folder, "events", "event_id")
    return keys.unionByName(keys).groupBy("key").agg(F.count(F.lit(1)).alias("passes"))


@query(q.with_(
    q.xxhash64("mixed", "(SELECT event_id AS key FROM events)", ("key", "42")),
    select=f"SELECT CAST(key AS BIGINT) AS draw, CAST(h % {q.wide(q.TWO32)} AS BIGINT) AS key FROM mixed",
))
def s4_uniform_keys(spark, folder):
    """One seeded draw per event."""
    return uniform_over(read_table(spark, folder, "events"), "event_id")


def stored_extent(spark, folder):
    """The events' user ids in event order as raw files; returns the path and the number of keys."""
    path = new_folder(spark, "extent")
    keys = read_table(spark, folder, "events").select("event_id", F.col("user_id").alias("key"))
    write_extent(keys.orderBy("event_id"), path)
    return path, read_table(spark, folder, "events").count()


@query("""WITH e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, user_id AS key, count(*) OVER () AS n FROM events),
both_writes AS (SELECT i, key, n FROM e UNION ALL SELECT n + row_number() OVER (ORDER BY o_orderkey) - 1, o_custkey, (SELECT max(n) FROM e) FROM orders, (SELECT max(n) AS n FROM e))
SELECT CASE WHEN i < n // 2 THEN 'low' WHEN i < n THEN 'high' ELSE 'appended' END AS part, 4 * i AS address, key FROM both_writes""")
def s6_extent_scan(spark, folder):
    """A raw extent written, appended to, and read back as byte ranges, the lowest one ending inside a key."""
    path, n = stored_extent(spark, folder)
    more = read_table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    write_extent(more.orderBy("o_orderkey"), path)
    half = 4 * (n // 2)
    low = read_extent(spark, path, 0, half + 3, chunk=4096).withColumn("part", F.lit("low"))
    high = read_extent(spark, path, half, 4 * n - half).withColumn("part", F.lit("high"))
    appended = read_extent(spark, path, 4 * n).withColumn("part", F.lit("appended"))
    return low.unionByName(high).unionByName(appended).select("part", "address", "key")


@query("""WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_orderkey AS key, max(o_orderkey) OVER () AS top,
count(*) OVER () AS n FROM orders)
SELECT CASE WHEN key <= top // 3 THEN 'low' WHEN i < n - n // 4 THEN 'middle' ELSE 'high' END AS part, 4 * i AS address,
CAST(key AS BIGINT) AS key FROM o""")
def s6_pruned_scan(spark, folder):
    """All orders' keys as an extent in key order, read back in three parts that each plan only the steps that can hold their
    keys; two of them are told apart by address."""
    orders = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"))
    top, n = orders.agg(F.coalesce(F.max("key"), F.lit(0)), F.count(F.lit(1))).first()
    path = new_folder(spark, "extent")
    write_extent(orders.orderBy("key"), path, step=4096)
    third, late = top // 3, 4 * (n - n // 4)
    low = read_extent(spark, path, highest_key=third).withColumn("part", F.lit("low"))
    middle = read_extent(spark, path, 0, late, lowest_key=third + 1).withColumn("part", F.lit("middle"))
    high = read_extent(spark, path, late, lowest_key=third + 1).withColumn("part", F.lit("high"))
    return low.unionByName(middle).unionByName(high).select("part", "address", "key")


@query(f"WITH {LINES_SQL} SELECT seq, last, CAST(lane AS INTEGER) AS lane, key, true AS valid FROM lines")
def s7_unpacked_lanes(spark, folder):
    return unpack_lines(event_lines(spark, folder))


@query(f"""WITH {LINES_SQL} SELECT seq, CAST(lane AS INTEGER) AS lane, key, true AS valid FROM lines UNION ALL
SELECT seq, CAST(r.lane AS INTEGER), 0, false FROM (SELECT seq, count(*) AS n FROM lines GROUP BY seq), range(16) AS r(lane)
WHERE r.lane >= n""")
def s7_padded_lanes(spark, folder):
    return unpack_lines(event_lines(spark, folder), ["seq"], "as_zero")


@query(f"""SELECT event_id // {KEYS_PER_PACKET} AS seq, CAST((event_id // {KEYS_PER_PACKET}) % 3 AS INTEGER) AS session_id,
user_id AS key, count(*) AS n FROM events GROUP BY ALL""")
def s8_packet_scan(spark, folder):
    path = new_folder(spark, "packets")
    event_packets(spark, folder).drop("last").write.parquet(path)
    keys = read_packets(spark, path).select("seq", "session_id", F.explode("payload").alias("key"))
    return keys.groupBy("seq", "session_id", "key").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LINES_SQL}, l AS (SELECT DISTINCT seq, last FROM lines)
SELECT seq, last, CAST(coalesce(sum(CAST(last AS INTEGER)) OVER
  (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS run_id FROM l""")
def s9_run_ids(spark, folder):
    return run_ids(event_lines(spark, folder).select("seq", "last"))


def runs_sql(padding):
    rows = f"SELECT seq // {LINES_PER_RUN} AS run_id, key FROM lines"
    if padding:
        rows += f" UNION SELECT seq // {LINES_PER_RUN}, 0 FROM lines"
    return q.with_(
        LINES_SQL, f"keyed AS MATERIALIZED ({rows})", q.distinct_keys("keyed", "key"), WORDS,
        q.registers("keyed", 64, 16, "run_id", "h1"), q.estimate("regs", 16, "run_id"),
        select="SELECT run_id, round(estimate, 6) AS estimate FROM est"
        f" WHERE run_id IN (SELECT seq // {LINES_PER_RUN} FROM lines WHERE last)",
    )


@query(runs_sql(False))
def w2_run_estimates(spark, folder):
    """Every finished run of lines, padding dropped."""
    return estimate_runs(event_lines(spark, folder)).select("run_id", rounded("estimate").alias("estimate"))


@query(runs_sql(True))
def w2_run_estimates_padded(spark, folder):
    """The same with every padded lane counted as key 0."""
    runs = estimate_runs(event_lines(spark, folder), padding="as_zero")
    return runs.select("run_id", rounded("estimate").alias("estimate"))


@query(f"WITH {LINES_SQL} SELECT last, count(DISTINCT seq) AS lines, count(*) AS keys FROM lines GROUP BY last")
def a13_lane_counter(spark, folder):
    return count_lane_keys(event_lines(spark, folder), ["last"])


def running_sql(by):
    part = f"PARTITION BY {by} " if by else ""
    return f"CAST(sum(tuples) OVER ({part}ORDER BY seq) AS BIGINT)"


@query(f"WITH {PACKETS_SQL} SELECT seq, session_id, {running_sql('')} AS running FROM packets")
def w1_running_tuples(spark, folder):
    return running_tuples(event_packets(spark, folder)).select("seq", "session_id", "running")


@query(f"WITH {PACKETS_SQL} SELECT seq, session_id, {running_sql('session_id')} AS running FROM packets")
def w1_running_tuples_by_session(spark, folder):
    return running_tuples(event_packets(spark, folder), ["session_id"]).select("seq", "session_id", "running")


GLOBAL_SIZE, SESSION_SIZE = 4 * KEYS_PER_PACKET, 5 * KEYS_PER_PACKET


def windows_sql(size, by):
    """The exact rule over running counts: window k ends where the count is k times the size, if all before it ended."""
    part, group = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    using = f"USING ({by})" if by else "ON true"
    return [
        PACKETS_SQL,
        f"counted AS (SELECT *, {running_sql(by)} AS running FROM packets)",
        f"hits AS (SELECT {group}running // {size} AS k, row_number() OVER ({part}ORDER BY running) AS nth"
        f" FROM counted WHERE tuples > 0 AND running % {size} = 0)",
        f"series AS (SELECT {group}max(k) AS closed FROM hits WHERE k = nth {'GROUP BY ' + by if by else ''})",
        f"""windowed AS MATERIALIZED (SELECT counted.*, coalesce(closed, 0) AS series,
          tuples > 0 AND running % {size} = 0 AND running // {size} <= coalesce(closed, 0) AS closes,
          least(running // {size}, coalesce(closed, 0)) + 1 - CAST(tuples > 0 AND running % {size} = 0
            AND running // {size} <= coalesce(closed, 0) AS BIGINT) AS window_id
          FROM counted LEFT JOIN series {using})""",
    ]


@query(q.with_(*windows_sql(GLOBAL_SIZE, ""), select="SELECT seq, session_id, window_id, closes FROM windowed"))
def w3_count_windows(spark, folder):
    return count_windows(event_packets(spark, folder), GLOBAL_SIZE).select("seq", "session_id", "window_id", "closes")


def window_estimates_sql(size, by, p, ctes, h, width):
    group = f"{by}, window_id" if by else "window_id"
    return [
        *windows_sql(size, by),
        f"keyed AS MATERIALIZED (SELECT {group}, user_id AS key FROM windowed JOIN events"
        f" ON event_id // {KEYS_PER_PACKET} = seq WHERE window_id <= series)",
        q.distinct_keys("events", "user_id"), ctes, q.registers("keyed", width, p, group, h),
        q.estimate("regs", p, group),
    ]


SESSION_WINDOWS = window_estimates_sql(SESSION_SIZE, "session_id", 16, WORDS, "h1", 64)
SESSION_WINDOWS_SQL = q.with_(*SESSION_WINDOWS, select="SELECT session_id, window_id, round(estimate, 6) AS estimate FROM est")


@query(SESSION_WINDOWS_SQL)
def w3_window_estimates_by_session(spark, folder):
    windowed = count_windows(event_packets(spark, folder), SESSION_SIZE, ["session_id"])
    estimates = estimate_windows(windowed, by=["session_id"])
    return estimates.select("session_id", "window_id", rounded("estimate").alias("estimate"))


def offsets_sql(by):
    part = f"{by}, window_id" if by else "window_id"
    return (
        f"CAST(coalesce(sum(length) OVER (PARTITION BY {part} ORDER BY seq"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"
    )


@query(q.with_(*windows_sql(GLOBAL_SIZE, ""), select=f"SELECT seq, window_id, {offsets_sql('')} AS \"offset\" FROM windowed"))
def w5_payload_offsets(spark, folder):
    packets = event_packets(spark, folder)
    levels = levels_for(packets, "seq")
    placed = place_packets(packets, lambda narrow: count_windows(narrow, GLOBAL_SIZE, levels=levels), levels=levels)
    return placed.select("seq", "window_id", "offset")


def tee_payload_sql(size, by):
    group = f"{by}, " if by else ""
    return q.with_(*windows_sql(size, by), select=f"""SELECT {group}window_id, seq, "offset", length, key, count(*) AS n
FROM (SELECT *, {offsets_sql(by)} AS "offset" FROM windowed) JOIN (SELECT event_id // {KEYS_PER_PACKET} AS seq, user_id AS key FROM events)
USING (seq) GROUP BY ALL""")


def tee_result_sql(size, by):
    group = f"{by}, window_id" if by else "window_id"
    return q.with_(
        *window_estimates_sql(size, by, 16, WORDS, "h1", 64),
        f"ends AS (SELECT {group}, CAST(sum(length) AS BIGINT) AS \"offset\" FROM windowed WHERE window_id <= series GROUP BY {group})",
        select=f"SELECT {group}, \"offset\", CAST(4 AS BIGINT) AS length, round(estimate, 6) AS estimate FROM ends JOIN est USING ({group})",
    )


def exploded(payload, *columns):
    """Payloads as counted keys, to compare them without array columns."""
    keys = payload.select(*columns, F.explode("payload").alias("key"))
    return keys.groupBy(*columns, "key").agg(F.count(F.lit(1)).alias("n"))


@query(tee_payload_sql(GLOBAL_SIZE, ""))
def k2_tee_payload(spark, folder):
    payload, _ = tee_windows(event_packets(spark, folder), GLOBAL_SIZE)
    long = payload.withColumn("length", F.col("length").cast("bigint"))
    return exploded(long, "window_id", "seq", "offset", "length")


@query(tee_result_sql(GLOBAL_SIZE, ""))
def k2_tee_result(spark, folder):
    _, result = tee_windows(event_packets(spark, folder), GLOBAL_SIZE)
    return result.withColumn("estimate", rounded("estimate"))


ORDERS = "SELECT 0 AS source, o_orderkey AS seq, o_custkey AS key FROM orders"
CUSTOMERS = "SELECT 1 AS source, c_custkey AS seq, CAST(c_nationkey AS BIGINT) AS key FROM customer"


def two_inputs(spark, folder):
    orders = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("key"))
    customers = read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("seq"), F.col("c_nationkey").cast("bigint").alias("key"))
    return orders, customers


@query(f"{ORDERS} UNION ALL {CUSTOMERS} ORDER BY source, seq")
def u1_priority_merge(spark, folder):
    return merge_priority(*two_inputs(spark, folder)).select("source", "seq", "key").orderBy("source", "seq")


TURNS = f"""both_inputs AS ({ORDERS} UNION ALL {CUSTOMERS}),
items AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) - 1 AS turn FROM both_inputs)"""
ORIGIN = """origin AS (SELECT event_id AS position, CAST(event_type = 'error' AS INTEGER) AS source FROM events),
slots AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY position) - 1 AS turn FROM origin)"""


def origin_table(spark, folder):
    events = read_table(spark, folder, "events")
    return events.select(F.col("event_id").alias("position"), (F.col("event_type") == "error").cast("int").alias("source"))


@query(f"WITH {TURNS}, {ORIGIN} SELECT position, source, seq, key FROM items JOIN slots USING (source, turn)")
def u2_merge_by_origin(spark, folder):
    """Event types say which input comes next."""
    merged = merge_by_origin(origin_table(spark, folder), *two_inputs(spark, folder))
    return merged.select("position", "source", "seq", "key")


def two_line_inputs(spark, folder):
    """Both inputs as packets of lines: an order ends its packet at every fifth key, a customer at every third."""
    orders, customers = two_inputs(spark, folder)
    return orders.withColumn("last", F.col("seq") % 5 == 4), customers.withColumn("last", F.col("seq") % 3 == 2)


PACKET_TURNS = f"""both_inputs AS ({ORDERS} UNION ALL {CUSTOMERS}),
marked AS (SELECT *, CASE source WHEN 0 THEN seq % 5 = 4 ELSE seq % 3 = 2 END AS last FROM both_inputs),
items AS (SELECT *, CAST(coalesce(sum(CAST(last AS INTEGER)) OVER (PARTITION BY source ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS turn FROM marked)"""


@query(f"WITH {PACKET_TURNS}, {ORIGIN} SELECT position, source, seq, key, last FROM items JOIN slots USING (source, turn)")
def u2_packet_merge_by_origin(spark, folder):
    merged = merge_by_origin(origin_table(spark, folder), *two_line_inputs(spark, folder), packets=True)
    return merged.select("position", "source", "seq", "key", "last")


@query(f"WITH {TURNS} SELECT turn, source, seq, key FROM items ORDER BY turn, source")
def u3_fair_merge(spark, folder):
    return merge_fair(*two_inputs(spark, folder)).select("turn", "source", "seq", "key").orderBy("turn", "source")


@query(f"WITH {PACKET_TURNS} SELECT turn, source, seq, key, last FROM items")
def u3_fair_packet_merge(spark, folder):
    merged = merge_fair(*two_line_inputs(spark, folder), packets=True)
    return merged.select("turn", "source", "seq", "key", "last")


@query(f"""WITH {PACKET_TURNS} SELECT CASE WHEN event_type = 'error' THEN 'second' ELSE 'first' END AS output, turn AS packet, seq, key
FROM items LEFT JOIN events ON event_id = turn WHERE source = 0""")
def u4_packet_split(spark, folder):
    """Orders as packets, routed by the type of the event with the packet's number."""
    lines, _ = two_line_inputs(spark, folder)
    flags = origin_table(spark, folder).withColumnsRenamed({"position": "packet", "source": "dest"})
    first, second = split_packets(lines, flags)
    both = first.withColumn("output", F.lit("first")).unionByName(second.withColumn("output", F.lit("second")))
    return both.select("output", "packet", "seq", "key")


@query("""SELECT event_id, CAST(sum(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) AS total,
max(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS highest FROM events""")
def w1_running_sum_and_maximum(spark, folder):
    """The running operator itself, cut into small blocks so that carries matter."""
    events = read_table(spark, folder, "events").select("event_id", "event_type", "user_id")
    sums = running(events, "event_id", {"total": F.col("user_id")}, ["event_type"], bits=8)
    return running(sums, "event_id", {"highest": F.col("user_id")}, ["event_type"], "max", bits=8).select(
        "event_id", "total", "highest")


@query("""SELECT event_id, CAST(sum(user_id) OVER (PARTITION BY event_type ORDER BY epoch_us(ts)) AS BIGINT) AS total FROM events""")
def w1_running_sum_by_time(spark, folder):
    """Sparse order values, so that totals are cut into blocks several times; events of one microsecond are added up first."""
    events = read_table(spark, folder, "events").withColumn("place", F.unix_micros(F.col("ts").cast("timestamp")))
    sums = events.groupBy("event_type", "place").agg(F.sum("user_id").alias("added"))
    totals = running(sums, "place", {"total": F.col("added")}, ["event_type"]).select("event_type", "place", "total")
    return events.join(totals, ["event_type", "place"]).select("event_id", "total")


@query("""SELECT event_id, CAST(sum(user_id) OVER (PARTITION BY event_type ORDER BY ts) AS BIGINT) AS total,
CAST(coalesce(sum(user_id) OVER (ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS overall,
CAST(sum(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
  - user_id AS before,
max(user_id) OVER (PARTITION BY event_type ORDER BY ts) AS highest FROM events""")
def w1_scan_by_time(spark, folder):
    """Running values along event times, ties and all, in two passes over ranges."""
    events = read_table(spark, folder, "events").select("event_id", "event_type", "user_id", "ts")
    total = scan(events, ["ts"], {"total": F.col("user_id")}, ["event_type"])
    overall = scan(total, ["ts"], {"overall": F.col("user_id")})
    before = scan(overall, ["ts", "event_id"], {"before": F.col("user_id")}, ["event_type"], inclusive=False)
    highest = scan(before, ["ts"], {"highest": F.col("user_id")}, ["event_type"], "max")
    return highest.select("event_id", "total", "overall", "before", "highest")


@query(q.with_(
    q.distinct_keys("events", "user_id"), WORDS, q.registers("(SELECT user_id AS key FROM events)", 64, 16, "", "h1"),
    q.estimate("regs", 16), select="SELECT CAST(0 AS BIGINT) AS run_id, round(estimate, 6) AS estimate FROM est",
))
def x6_extent_to_result(spark, folder):
    """Extent, sketch and result path as plain options of one flow."""
    path, n = stored_extent(spark, folder)
    results = new_folder(spark, "result")
    estimate_extent(spark, path, results, offset=0, length=4 * n)
    return spark.read.parquet(results).select("run_id", rounded("estimate").alias("estimate"))


AT_LEAST = 3 * KEYS_PER_PACKET - 5
WALK = f"""ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS nth FROM packets),
walk AS (SELECT session_id, nth, seq, length, tuples AS held, CAST(1 AS BIGINT) AS window_id FROM ordered WHERE nth = 1
  UNION ALL SELECT o.session_id, o.nth, o.seq, o.length, CASE WHEN held >= {AT_LEAST} THEN o.tuples ELSE held + o.tuples END,
    window_id + CAST(held >= {AT_LEAST} AS BIGINT)
  FROM walk JOIN ordered o ON o.session_id = walk.session_id AND o.nth = walk.nth + 1)"""


@query(q.with_(
    PACKETS_SQL, WALK, select=f"SELECT session_id, seq, window_id, held >= {AT_LEAST} AS closes FROM walk", recursive=True,
))
def w3_reaching_windows(spark, folder):
    """Windows that close at the first packet reaching the size, cut in small blocks so that their summaries matter."""
    windowed = reaching_windows(event_packets(spark, folder), AT_LEAST, ["session_id"], bits=6)
    return windowed.select("session_id", "seq", "window_id", "closes")
