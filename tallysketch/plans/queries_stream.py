"""Streaming queries: each runs its stream to the end of the input and reads back what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.registers import build_registers
from ..operators.routing import item_turns
from ..sources.packets import stream_packets
from ..sources.sinks import write_batch
from ..sources.tables import read_table
from ..storage import new_folder
from ..streaming.registers import (
    event_time_estimates, keep_estimates, keep_event_time_estimates, keep_registers, read_kept_registers, start,
)
from ..streaming.counters import StreamCounters, keep_counted_registers
from ..streaming.keyed import KeyedWindows
from ..streaming.merging import keep_merged, merge_streams_by_origin
from ..streaming.windows import PacketWindows
from . import sqltext as q
from .catalog import KEYS_PER_PACKET, PACKETS_SQL, SESSIONS, event_packets, query, rounded
from .queries_sketch import ESTIMATE, REGISTERS, registers_sql
from .queries_source import (
    AT_LEAST, GLOBAL_SIZE, ORIGIN, SESSION_SIZE, TURNS, exploded, origin_table, tee_payload_sql, tee_result_sql, two_inputs, WALK, window_estimates_sql, WORDS,
)

BATCHES = 4


def event_stream(spark, folder):
    """The events file as a stream."""
    path = f"{folder}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def run_in_chunks(spark, frame, order, run):
    """Append a table to an inbox in ``BATCHES`` ranges of ``order`` and run the stream to its end after each.

    Every run is a new query on the checkpoint of the one before.
    """
    inbox = new_folder(spark, "inbox")
    bounds = frame.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    step = (bounds.high - bounds.low) // BATCHES + 1
    for i in range(BATCHES):
        low = bounds.low + i * step
        part = F.col(order).between(low, low + step - 1)
        frame.where(part | F.col(order).isNull() if i == 0 else part).write.mode("append").parquet(inbox)
        run(spark.readStream.schema(frame.schema).parquet(inbox)).awaitTermination()


@query(q.with_(*registers_sql("events", "user_id", p=12), select=REGISTERS))
def t1_stream_registers(spark, folder):
    out = new_folder(spark, "registers")
    keep_registers(event_stream(spark, folder), out, "user_id", 12).awaitTermination()
    return read_kept_registers(spark, out)


@query(q.with_(*registers_sql("events", "user_id", p=12, by="event_type"),
               select="SELECT event_type, bucket, CAST(rank AS TINYINT) AS rank FROM regs"))
def t1_stream_registers_by_type(spark, folder):
    """Several micro-batches; each writes only the registers that changed."""
    out = new_folder(spark, "registers")
    events = read_table(spark, folder, "events").select("event_id", "event_type", "user_id")
    run_in_chunks(spark, events, "event_id", lambda s: keep_registers(s, out, "user_id", 12, by=["event_type"]))
    return read_kept_registers(spark, out, ["event_type"])


SEEN = f"""(SELECT b AS batch_id, user_id AS key FROM events, range({BATCHES}) AS r(b),
  (SELECT min(event_id) AS low, (max(event_id) - min(event_id)) // {BATCHES} + 1 AS step FROM events)
  WHERE event_id < low + (b + 1) * step)"""


@query(q.with_(*registers_sql("events", "user_id", by="batch_id", rows=SEEN), q.estimate("regs", 14, "batch_id"),
               select=f"SELECT CAST(batch_id AS INTEGER) AS batch_id, {ESTIMATE} FROM est"))
def t2_running_estimate(spark, folder):
    """The estimate after each micro-batch of several; the registers are folded after every second."""
    out = new_folder(spark, "estimates")
    events = read_table(spark, folder, "events").select("event_id", "user_id")
    run_in_chunks(spark, events, "event_id", lambda s: keep_estimates(s, out, "user_id", compact=2))
    return spark.read.parquet(f"{out}/estimates").select("batch_id", rounded("estimate").alias("estimate"))


@query(q.with_(*registers_sql("events", "user_id", p=12, by="session_id",
                              rows=f"(SELECT (event_id // {KEYS_PER_PACKET}) % 3 AS session_id, user_id AS key FROM events)"),
               select="SELECT CAST(session_id AS INTEGER) AS session_id, bucket, CAST(rank AS TINYINT) AS rank FROM regs"))
def s8_packet_stream(spark, folder):
    """Packets as a stream of one file per micro-batch, sketched per session."""
    path, out = new_folder(spark, "packets"), new_folder(spark, "registers")
    event_packets(spark, folder).drop("last").repartition(BATCHES).write.parquet(path)
    keys = stream_packets(spark, path, files_per_batch=1).select("session_id", F.explode("payload").alias("key"))
    keep_registers(keys, out, "key", 12, by=["session_id"], compact=2).awaitTermination()
    return read_kept_registers(spark, out, ["session_id"])


@query(f"""WITH bounds AS (SELECT min(event_id) AS low, (max(event_id) - min(event_id)) // {BATCHES} + 1 AS step FROM events),
batches AS (SELECT (event_id - low) // step AS batch_id, user_id AS key FROM events, bounds),
{q.distinct_keys("events", "user_id")}, {q.murmur3_32()}
SELECT CAST(batch_id AS BIGINT) AS batch_id, count(key) AS keys, count(*) - count(key) AS nulls,
  count(DISTINCT h // {1 << (32 - 12)}) AS registers, count(*) AS input_rows
FROM batches LEFT JOIN hashed USING (key) GROUP BY batch_id""")
def a12_stream_counters(spark, folder):
    """Keys in and registers out of every micro-batch, as the listener has received them."""
    out, counters, ids = new_folder(spark, "registers"), StreamCounters().attach(spark), []
    events = read_table(spark, folder, "events").select("event_id", "user_id")

    def run(stream):
        running = keep_counted_registers(stream, out, "user_id", 12)
        ids.append(running.id)
        running.awaitTermination()
        counters.wait(running)
        return running

    try:
        run_in_chunks(spark, events, "event_id", run)
    finally:
        counters.detach(spark)
    return counters.table(spark, ids[-1]).select("batch_id", "keys", "nulls", "registers", "input_rows")


def run_windows(spark, folder, **options):
    """The event packets in a stream of several micro-batches through counted windows."""
    window = PacketWindows(new_folder(spark, "windows"), **options)
    run_in_chunks(spark, event_packets(spark, folder), "seq", window.start)
    return window


@query(tee_result_sql(SESSION_SIZE, "session_id"))
def t3_count_windows(spark, folder):
    """Windows of a fixed number of keys per session, closing on an exact hit."""
    window = run_windows(spark, folder, size=SESSION_SIZE, close="exact")
    return window.results(spark).withColumn("estimate", rounded("estimate"))


CLOSED = f"""closed AS (SELECT session_id, window_id, CAST(sum(length) AS BIGINT) AS "offset" FROM walk
  GROUP BY session_id, window_id HAVING max(held) >= {AT_LEAST})"""
MARKED = """marked AS (SELECT *, 1 + CAST(coalesce(sum(CAST(last AS INTEGER)) OVER (PARTITION BY session_id ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS window_id FROM packets),
walk AS (SELECT session_id, seq, length, window_id FROM marked),
closed AS (SELECT session_id, window_id, CAST(sum(length) AS BIGINT) AS "offset" FROM marked
  GROUP BY session_id, window_id HAVING bool_or(last))"""


def walked_sql(walk):
    m32 = q.murmur3_32()
    return q.with_(
        PACKETS_SQL, walk,
        f"keyed AS MATERIALIZED (SELECT session_id, window_id, user_id AS key FROM walk JOIN events ON event_id // {KEYS_PER_PACKET} = seq"
        " SEMI JOIN closed USING (session_id, window_id))",
        q.distinct_keys("events", "user_id"), m32, q.registers("keyed", 32, 12, "session_id, window_id"),
        q.estimate("regs", 12, "session_id, window_id"),
        select="SELECT session_id, window_id, \"offset\", CAST(4 AS BIGINT) AS length, round(estimate, 6) AS estimate"
        " FROM closed JOIN est USING (session_id, window_id)",
        recursive=True,
    )


@query(walked_sql(f"{WALK},\n{CLOSED}"))
def t3_windows_at_least(spark, folder):
    """Windows that close at the first packet reaching the size."""
    window = run_windows(spark, folder, size=AT_LEAST, p=12, hash="murmur3_32")
    return window.results(spark).withColumn("estimate", rounded("estimate"))


@query(walked_sql(MARKED))
def t4_marker_windows(spark, folder):
    """Windows that close at marked packets."""
    window = run_windows(spark, folder, close="last", p=12, hash="murmur3_32")
    return window.results(spark).withColumn("estimate", rounded("estimate"))


@query(q.with_(*window_estimates_sql(SESSION_SIZE, "session_id", 10, q.murmur3_32(), "h", 32),
               select="SELECT session_id, window_id, zeros, round(harmonic, 6) AS harmonic FROM est"))
def t5_reset_at_close(spark, folder):
    """Every window of a stream starts from empty registers: its zeros and sums are those of its own keys."""
    window = run_windows(spark, folder, size=SESSION_SIZE, close="exact", p=10, hash="murmur3_32")
    estimates = window.closed_estimates(spark)
    return estimates.select("session_id", "window_id", "zeros", rounded("harmonic").alias("harmonic"))


@query(tee_result_sql(GLOBAL_SIZE, ""))
def t6_one_window_series(spark, folder):
    """Session ids ignored: one series of windows over all packets."""
    window = run_windows(spark, folder, size=GLOBAL_SIZE, close="exact", by=())
    return window.results(spark).withColumn("estimate", rounded("estimate"))


@query(tee_payload_sql(SESSION_SIZE, "session_id"))
def t7_stream_payload(spark, folder):
    """Payloads passed through with their offsets."""
    window = run_windows(spark, folder, size=SESSION_SIZE, close="exact")
    return exploded(window.payloads(spark), "session_id", "window_id", "seq", "offset", "length")


SESSION_PACKETS = 20
#: Every twentieth packet of a session closes it, so its id starts anew with the next.
OPENED = f"""packets AS MATERIALIZED (SELECT *, seq // {SESSIONS * SESSION_PACKETS} * {SESSIONS * SESSION_PACKETS} + session_id AS opened
  FROM plain_packets)"""


def reopened_sql(parts):
    """The given expressions with sessions told apart by their first packet."""
    text = q.with_(*parts[:-1], select=parts[-1], recursive=True)
    return text.replace("packets AS MATERIALIZED (", "plain_packets AS MATERIALIZED (", 1).replace(
        "FROM events GROUP BY ALL)", f"FROM events GROUP BY ALL),\n{OPENED}", 1)


def keyed_sql(*parts):
    return reopened_sql([*parts, """SELECT session_id, opened, window_id, "offset", CAST(4 AS BIGINT) AS length,
  round(estimate, 6) AS estimate FROM ends JOIN est USING (session_id, opened, window_id)"""])


def run_keyed_windows(spark, folder, **options):
    """The event packets, with sessions that close, in several micro-batches through windows held as keyed state."""
    windows = KeyedWindows(new_folder(spark, "keyed"), **options)
    closed = F.expr(f"seq div {SESSIONS} % {SESSION_PACKETS} = {SESSION_PACKETS - 1}")
    run_in_chunks(spark, event_packets(spark, folder).withColumn("closed", closed), "seq", windows.start)
    return windows.read(spark).withColumn("estimate", rounded("estimate"))


@query(keyed_sql(
    *window_estimates_sql(SESSION_SIZE, "session_id, opened", 16, WORDS, "h1", 64),
    "ends AS (SELECT session_id, opened, window_id, CAST(sum(length) AS BIGINT) AS \"offset\" FROM windowed"
    " WHERE window_id <= series GROUP BY session_id, opened, window_id)",
))
def t3_keyed_windows(spark, folder):
    """Windows closing on an exact hit, as state of sessions that close and start again."""
    return run_keyed_windows(spark, folder, size=SESSION_SIZE, close="exact")


KEYED_WALK = f"""ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id, opened ORDER BY seq) AS nth FROM packets),
walk AS (SELECT session_id, opened, nth, seq, length, tuples AS held, CAST(1 AS BIGINT) AS window_id FROM ordered WHERE nth = 1
  UNION ALL SELECT o.session_id, o.opened, o.nth, o.seq, o.length,
    CASE WHEN held >= {AT_LEAST} THEN o.tuples ELSE held + o.tuples END, window_id + CAST(held >= {AT_LEAST} AS BIGINT)
  FROM walk JOIN ordered o ON o.session_id = walk.session_id AND o.opened = walk.opened AND o.nth = walk.nth + 1)"""


@query(keyed_sql(
    PACKETS_SQL, KEYED_WALK,
    f"""ends AS (SELECT session_id, opened, window_id, CAST(sum(length) AS BIGINT) AS "offset" FROM walk
  GROUP BY session_id, opened, window_id HAVING max(held) >= {AT_LEAST})""",
    f"keyed AS MATERIALIZED (SELECT session_id, opened, window_id, user_id AS key FROM walk JOIN events"
    f" ON event_id // {KEYS_PER_PACKET} = seq SEMI JOIN ends USING (session_id, opened, window_id))",
    q.distinct_keys("events", "user_id"), q.murmur3_32(), q.registers("keyed", 32, 12, "session_id, opened, window_id"),
    q.estimate("regs", 12, "session_id, opened, window_id"),
))
def t3_keyed_windows_at_least(spark, folder):
    """Windows that close at the first packet reaching the size, as keyed state."""
    return run_keyed_windows(spark, folder, size=AT_LEAST, p=12, hash="murmur3_32")


def event_windows_sql(length, slide):
    """Windows of whole hours that the watermark has passed at the end of the input."""
    copies = length // slide
    rows = f"""timed AS MATERIALIZED (SELECT w.start AS window_start, w.start + {length} * 3600 AS window_end, key FROM (
      SELECT (CAST(floor(epoch(ts)) AS BIGINT) // ({slide} * 3600) - i) * ({slide} * 3600) AS start, user_id AS key
      FROM events, range({copies}) AS r(i)) w)"""
    group = "window_start, window_end"
    return q.with_(
        rows, q.distinct_keys("events", "user_id"), q.murmur3_32(), q.registers("timed", 32, 12, group),
        q.estimate("regs", 12, group),
        select="SELECT CAST(window_start AS BIGINT) AS window_start, CAST(window_end AS BIGINT) AS window_end,"
        " round(estimate, 6) AS estimate FROM est"
        " WHERE window_end <= (SELECT max(epoch(ts)) - 3600 FROM events)",
    )


def finished_windows(spark, folder, length, slide=None):
    out = new_folder(spark, "event-time")
    estimates = event_time_estimates(event_stream(spark, folder), "user_id", "ts", length, slide, "1 hour", 12)
    keep_event_time_estimates(estimates, out).awaitTermination()
    return spark.read.parquet(f"{out}/windows").select(
        F.unix_seconds("window_start").alias("window_start"), F.unix_seconds("window_end").alias("window_end"),
        rounded("estimate").alias("estimate"))


@query(event_windows_sql(24, 24))
def t8_event_time_tumbling(spark, folder):
    return finished_windows(spark, folder, "24 hours")


@query(event_windows_sql(12, 4))
def t8_event_time_sliding(spark, folder):
    return finished_windows(spark, folder, "12 hours", "4 hours")


@query("""SELECT event_type = 'error' AS routed, count(*) AS events FROM events GROUP BY 1""")
def u4_stream_split(spark, folder):
    """One stream split to two tables by a flag."""
    out = new_folder(spark, "split")

    def route(batch, batch_id):
        batch = batch.persist()
        for flag in (True, False):
            write_batch(batch.where(F.col("routed") == flag).drop("routed"), f"{out}/{str(flag).lower()}", batch_id)
        batch.unpersist()

    events = event_stream(spark, folder).select("event_id", (F.col("event_type") == "error").alias("routed"))
    start(events.writeStream.foreachBatch(route), f"{out}/checkpoint", True).awaitTermination()
    parts = [spark.read.parquet(f"{out}/{str(f).lower()}").withColumn("routed", F.lit(f)) for f in (True, False)]
    return parts[0].unionByName(parts[1]).groupBy("routed").agg(F.count(F.lit(1)).alias("events"))


@query(f"WITH {TURNS}, {ORIGIN} SELECT position, source, seq, key FROM items JOIN slots USING (source, turn)")
def u2_stream_merge(spark, folder):
    """Orders and customers as two streams, merged in the order of a third that event types give, over several batches.

    The three streams run at their own speeds: the k-th batch has the k-th part of each.
    """
    first, second = two_inputs(spark, folder)
    frames = {
        "origin": item_turns(origin_table(spark, folder), ["source"], "position"),
        "first": item_turns(first), "second": item_turns(second),
    }
    inboxes, parts, out, slack = {}, {}, new_folder(spark, "merged"), 1
    for name, frame in frames.items():
        stored = new_folder(spark, name)
        frame.write.parquet(stored)
        frames[name] = frame = spark.read.parquet(stored)
        inboxes[name] = new_folder(spark, f"inbox-{name}")
        order = "position" if name == "origin" else "turn"
        step = F.lit(frame.agg(F.max(order)).first()[0] // BATCHES + 1)
        parts[name] = F.call_function("div", F.col(order), step)
    for part in range(BATCHES):
        for name, frame in frames.items():
            frame.where(parts[name] == part).write.mode("append").parquet(inboxes[name])
        streams = [spark.readStream.schema(frames[n].schema).parquet(inboxes[n]) for n in ("origin", "first", "second")]
        keep_merged(merge_streams_by_origin(*streams, slack), out).awaitTermination()
    return spark.read.parquet(f"{out}/merged").select("position", "source", "seq", "key")
