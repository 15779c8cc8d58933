"""Register streams: what they keep equals the batch result, also across restarts and replayed batches."""

from pyspark.sql import functions as F

from tallysketch import approx_distinct, build_registers
from tallysketch.plans.catalog import event_packets
from tallysketch.sources.packets import stream_packets
from tallysketch.sources.tables import read_table
from tallysketch.storage import new_folder, shared_folder
from tallysketch.streaming.registers import event_time_estimates, keep_estimates, keep_registers, read_kept_registers
from tallysketch.streaming.windows import PacketWindows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_folder(spark, "x") != new_folder(spark, "x")


def test_registers_survive_a_restart(spark, tables):
    events = read_table(spark, tables, "events").select("event_id", "event_type", "user_id")
    inbox, out = new_folder(spark, "inbox"), new_folder(spark, "out")
    for i in (0, 1):
        events.where(F.col("event_id") % 2 == i).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(events.schema).parquet(inbox)
        keep_registers(stream, out, "user_id", 12, by=["event_type"]).awaitTermination()
    kept = read_kept_registers(spark, out, ["event_type"])
    assert rows(kept) == rows(build_registers(events, "user_id", 12, by=["event_type"]))


def test_golden_stream_registers(spark):
    events = read_table(spark, "/root/testdata/sf0.01", "events").select("user_id")
    inbox, out = new_folder(spark, "inbox"), new_folder(spark, "out")
    events.write.parquet(inbox)
    keep_registers(spark.readStream.schema(events.schema).parquet(inbox), out, "user_id", 12).awaitTermination()
    assert read_kept_registers(spark, out).agg(F.count("*"), F.sum("rank")).first() == (149, 301)


def test_estimate_after_every_batch(spark):
    inbox, out = new_folder(spark, "inbox"), new_folder(spark, "out")
    for i in range(3):
        spark.range(i * 100, i * 100 + 150).coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema("id BIGINT").option("maxFilesPerTrigger", 1).parquet(inbox)
    keep_estimates(stream, out, "id", 10).awaitTermination()
    got = [r.estimate for r in spark.read.parquet(f"{out}/estimates").orderBy("batch_id").collect()]
    ends = (150, 250, 350)
    assert got == [approx_distinct(spark.range(end), "id", 10).first().estimate for end in ends]


def test_event_time_windows_agree_with_batch_and_drop_late_rows(spark):
    schema = "ts TIMESTAMP_NTZ, key BIGINT"
    inbox, out = new_folder(spark, "inbox"), new_folder(spark, "out")
    batches = [
        [("2024-01-01 00:10:00", 1), ("2024-01-01 00:50:00", 2), ("2024-01-01 02:30:00", 3)],
        [("2024-01-01 00:20:00", 9), ("2024-01-01 03:59:00", 4)],
        [("2024-01-01 08:00:00", 5)],
    ]
    from tallysketch.streaming.registers import keep_event_time_estimates

    for batch in batches:
        frame = spark.createDataFrame(batch, "ts STRING, key BIGINT").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "key")
        frame.coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        estimates = event_time_estimates(stream, "key", "ts", "1 hour", delay="30 minutes", p=10)
        keep_event_time_estimates(estimates, out).awaitTermination()
    got = {r.window_start.hour: round(r.estimate) for r in spark.read.parquet(f"{out}/windows").collect()}
    # Key 9 came after its window had closed; the last window is still open.
    assert got == {0: 2, 2: 1, 3: 1}
    batch = event_time_estimates(spark.createDataFrame(batches[0], "ts STRING, key BIGINT"), "key", "ts", "1 hour", p=10)
    assert {r.window_start.hour: round(r.estimate) for r in batch.collect()} == {0: 2, 2: 1}


def test_replayed_batch_changes_nothing(spark, tables):
    packets = event_packets(spark, tables)
    window = PacketWindows(new_folder(spark, "windows"), 100, "at_least", p=8)
    halves = [packets.where("seq < 15"), packets.where("seq >= 15")]
    for batch_id, half in enumerate(halves):
        window.process(half, batch_id)
    before = rows(window.results(spark))
    window.process(halves[1], 1)
    assert rows(window.results(spark)) == before
    assert window.payloads(spark).count() == packets.count()


def test_packet_stream_source(spark, tables):
    path = new_folder(spark, "packets")
    event_packets(spark, tables).drop("last").write.json(path)
    stream = stream_packets(spark, path, "json", files_per_batch=1)
    assert stream.isStreaming and "payload" in stream.columns


def test_streams_merge_as_batches_do_and_forget(spark):
    """Three streams at different speeds, unordered inside batches; what has met is forgotten."""
    from tallysketch.operators.routing import item_turns, merge_by_origin
    from tallysketch.streaming.merging import keep_merged, merge_streams_by_origin

    origin = spark.range(400).select(F.col("id").alias("position"), (F.col("id") % 2).cast("int").alias("source"))
    first = spark.range(200).select((F.col("id") * 2).alias("seq"), F.lit("f").alias("name"))
    second = spark.range(210).select(F.col("id").alias("seq"), F.lit("s").alias("name"))
    frames = [item_turns(origin, ["source"], "position"), item_turns(first), item_turns(second)]
    inboxes, out = [new_folder(spark, f"inbox{i}") for i in range(3)], new_folder(spark, "out")
    states = []
    for part in range(5):
        for frame, inbox, speed in zip(frames, inboxes, (50, 40, 45)):
            own = frame.where(F.expr(f"least(turn div {speed}, 4) = {part}"))
            own.orderBy(F.rand(1)).write.mode("append").parquet(inbox)
        streams = [spark.readStream.schema(f.schema).parquet(i) for f, i in zip(frames, inboxes)]
        query = keep_merged(merge_streams_by_origin(*streams, slack=1), out)
        query.awaitTermination()
        states.append(sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]))
    merged = spark.read.parquet(f"{out}/merged").select("position", "source", "seq", "name")
    batch = merge_by_origin(origin, first, second).select("position", "source", "seq", "name")
    assert rows(merged) == rows(batch) and len(rows(merged)) > 300
    assert states[-1] < 300  # of 810 rows that came in


def merged_in_batches(spark, batches, schemas, out, **options):
    """Each batch holds the rows that every one of the three streams brings; a run for each on one checkpoint."""
    from tallysketch.streaming.merging import keep_merged, merge_streams_by_origin

    inboxes = [new_folder(spark, f"inbox{i}") for i in range(3)]
    for batch in batches:
        for rows_, schema, inbox in zip(batch, schemas, inboxes):
            spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(inbox)
        streams = [spark.readStream.schema(schema).parquet(inbox) for schema, inbox in zip(schemas, inboxes)]
        query = keep_merged(merge_streams_by_origin(*streams, **options), out)
        query.awaitTermination()
    return query


def test_rows_that_wait_are_packed_in_state(spark):
    from tallysketch.operators.routing import item_turns, merge_by_origin
    from tallysketch.streaming.merging import keep_merged, merge_streams_by_origin

    origin = spark.range(9000).select(F.col("id").alias("position"), (F.col("id") % 3 == 0).cast("int").alias("source"))
    first = spark.range(20000).select((F.col("id") * 2).alias("seq"))
    second = spark.range(100).select(F.col("id").alias("seq"))
    frames = [item_turns(origin, ["source"], "position"), item_turns(first), item_turns(second)]
    inboxes, out = [new_folder(spark, f"inbox{i}") for i in range(3)], new_folder(spark, "out")
    for part in range(2):
        for frame, inbox, half in zip(frames, inboxes, (1500, 10000, 50)):
            frame.where(F.expr(f"least(turn div {half}, 1) = {part}")).write.mode("append").parquet(inbox)
        streams = [spark.readStream.schema(f.schema).parquet(i) for f, i in zip(frames, inboxes)]
        query = keep_merged(merge_streams_by_origin(*streams, slack=1), out)
        query.awaitTermination()
    merged = spark.read.parquet(f"{out}/merged").select("position", "source", "seq")
    assert rows(merged) == rows(merge_by_origin(origin, first, second).select("position", "source", "seq"))
    # 20,000 items and 9,000 entries wait for the second stream: five blocks of the first source, and one of the other.
    assert sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]) <= 6


ODD = [
    "position LONG, source INT, turn INT",
    "turn LONG, name STRING, number LONG, part DOUBLE, list ARRAY<LONG>, at TIMESTAMP, raw BINARY",
]


def test_merged_rows_keep_their_values(spark):
    """Turns that repeat meet every time, across batches and blocks; NULLs, NaN and long numbers stay what they are."""
    from datetime import datetime

    big, at = 2**53 + 1, datetime(2024, 3, 31, 2, 30)
    batches = [
        ([(0, 0, 0), (1, 0, 5), (2, 1, 0), (None, 0, 1), (9, 7, 0), (10, None, 0)],
         [(0, None, None, None, None, None, None), (5, "f5", big, float("nan"), [big, None], at, b"\xff")],
         [(0, "s0", 1, -0.0, [], None, b"")]),
        ([(3, 0, 5), (4, 0, None), (5, 0, 6)],
         [(1, "f1", -big, 0.5, None, at, None), (5, "again", None, 1.0, [None], None, b"x"), (None, "none", 1, 1.0, [], at, b"")],
         [(5, "s5", 1, 1.0, [], at, b"")]),
        ([(6, 0, 1), (7, 1, 5)], [(6, "f6", 2, 2.0, [3], at, b"y")], [(9, "s9", 1, 1.0, [], at, b"")]),
    ]
    out, schemas = new_folder(spark, "out"), [ODD[0], ODD[1], ODD[1]]
    merged_in_batches(spark, batches, schemas, out, bits=1)
    whole = [spark.createDataFrame(sum((b[i] for b in batches), []), schemas[i]) for i in range(3)]
    names = ["position", "source", *whole[1].columns[1:]]
    expected = [
        whole[0].where(F.col("source") == s).join(whole[s + 1], "turn").select(*names) for s in (0, 1)]
    merged = spark.read.parquet(f"{out}/merged").select(*names)
    assert [repr(r) for r in rows_by_text(merged)] == [repr(r) for r in rows_by_text(expected[0].unionByName(expected[1]))]
    assert merged.count() == 10


def rows_by_text(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_merged_rows_that_come_late_are_dropped(spark):
    schemas = ["position LONG, source INT, turn LONG", "seq LONG, turn LONG", "seq LONG, turn LONG"]
    turns = range(10)
    batches = [
        ([(t, 0, t) for t in turns] + [(10 + t, 1, t) for t in turns], [(t, t) for t in turns if t not in (3, 9)],
         [(t, t) for t in turns]),
        # Turns 3, 4 and 5 are too late, 5 on both sides; turn 7 and those after it are not, so 7 meets all that is held.
        ([(30, 0, 4), (31, 0, 10), (32, 0, 5), (33, 0, 7)], [(3, 3), (9, 9), (10, 10), (55, 5), (77, 7)], [(10, 10)]),
    ]
    out = new_folder(spark, "out")
    merged_in_batches(spark, batches, schemas, out, slack=1, bits=2)
    got = rows(spark.read.parquet(f"{out}/merged").select("position", "source", "seq"))
    more = [(31, 0, 10), (33, 0, 7), (33, 0, 77), (7, 0, 77)]
    assert got == sorted([(t, 0, t) for t in turns if t != 3] + [(10 + t, 1, t) for t in turns] + more)
