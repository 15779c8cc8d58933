"""Windows as keyed state, and counters of running streams."""

import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallysketch import approx_distinct
from tallysketch.storage import new_folder
from tallysketch.streaming.counters import StreamCounters, keep_counted_registers
from tallysketch.streaming.keyed import KeyedWindows, closing_packets

SCHEMA = "seq BIGINT, session_id INT, length INT, closed BOOLEAN, last BOOLEAN, payload ARRAY<BIGINT>"


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def walked(packets, size, close):
    """{(session, opened, window): (bytes, keys)} of a plain walk over packets in order."""
    state, out = {}, {}
    for seq, session, length, closed, last, payload in sorted(packets, key=lambda p: p[0]):
        if not length and not closed:
            continue
        opened, window, held, size_, keys = state.get(session, (seq, 1, 0, 0, []))
        held, size_, keys = held + (length or 0) // 4, size_ + (length or 0), keys + [k for k in payload or [] if k is not None]
        ends = {"at_least": held >= size, "exact": bool((length or 0) // 4) and held == size, "last": bool(last)}[close]
        if ends:
            out[session, opened, window] = (size_, set(keys))
            window, held, size_, keys = window + 1, 0, 0, []
        state[session] = (opened, window, held, size_, keys)
        if closed:
            del state[session]
    return out, len(state)


def some_packets():
    rng = random.Random(8)
    packets = []
    for seq in range(240):
        keys = [rng.choice([None, rng.randrange(50), rng.randrange(10 ** 6)]) for _ in range(rng.choice([0, 1, 4, 4, 8]))]
        session = rng.choice([1, 1, 1, 2, 3, None])
        packets.append((seq, session, 4 * len(keys), rng.random() < 0.06, rng.random() < 0.2, keys if keys else None))
    return packets


def stream_in(spark, packets, windows, cuts):
    """Feed the packets in so many batches; every batch is a new query on the same checkpoint."""
    inbox = new_folder(spark, "inbox")
    query = None
    for part in np.array_split(np.arange(len(packets)), cuts):
        own = [packets[i] for i in part]
        random.Random(1).shuffle(own)
        spark.createDataFrame(own, SCHEMA).repartition(3).write.mode("append").parquet(inbox)
        query = windows.start(spark.readStream.schema(SCHEMA).parquet(inbox))
        query.awaitTermination()
    return query


@pytest.mark.parametrize("close", ["at_least", "exact", "last"])
def test_keyed_windows_are_a_walk_over_restarts(spark, close):
    packets = some_packets()
    windows = KeyedWindows(new_folder(spark, "keyed"), 12, close, p=10, hash="murmur3_32")
    query = stream_in(spark, packets, windows, 4)
    truth, left = walked(packets, 12, close)
    found = {(r.session_id, r.opened, r.window_id): (r.offset, r.estimate) for r in windows.read(spark).collect()}
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in truth.items()} and len(truth) > 5
    for key, (_, keys) in truth.items():
        mine = spark.createDataFrame([(k,) for k in keys], "key BIGINT")
        assert abs(found[key][1] - approx_distinct(mine, "key", 10).first().estimate) < 1e-9
    # A count and the registers for each session that is still open.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 2 * left


def test_no_state_is_left_when_all_sessions_have_closed(spark):
    packets = [p[:3] + (False,) + p[4:] for p in some_packets()]
    ends = [(1000 + i, s, 0, True, None, None) for i, s in enumerate([1, 2, 3, None])]
    windows = KeyedWindows(new_folder(spark, "keyed"), 12, p=8)
    query = stream_in(spark, packets, windows, 2)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 8
    query = stream_in(spark, packets + ends, KeyedWindows(new_folder(spark, "keyed"), 12, p=8), 3)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_one_series_without_sessions_and_a_wide_hash(spark):
    packets = [p[:3] + (False,) + p[4:] for p in some_packets()]
    windows = KeyedWindows(new_folder(spark, "keyed"), 40, by=(), p=6, hash="murmur3_128")
    stream_in(spark, packets, windows, 3)
    truth, _ = walked([(p[0], 0, *p[2:]) for p in packets], 40, "at_least")
    found = windows.read(spark).orderBy("window_id").collect()
    assert [(r.opened, r.window_id, r.offset) for r in found] == [(*k[1:], v[0]) for k, v in sorted(truth.items())]
    keys = spark.createDataFrame([(k,) for k in truth[min(truth)][1]], "key BIGINT")
    assert abs(found[0].estimate - approx_distinct(keys, "key", 6, "murmur3_128").first().estimate) < 1e-9


def test_silent_sessions_go_after_their_time(spark):
    windows = KeyedWindows(new_folder(spark, "keyed"), 4, p=8, idle="1 second")
    inbox = new_folder(spark, "inbox")
    for i in range(2):
        spark.createDataFrame([(i, 1, 8, False, False, [1, 2])], SCHEMA).write.mode("append").parquet(inbox)
        windows.start(spark.readStream.schema(SCHEMA).parquet(inbox)).awaitTermination()
        threading.Event().wait(2)
    assert windows.read(spark).count() == 0  # without the limit the second packet closes a window


def test_closing_packets():
    tuples, last = np.array([3, 4, 0, 5, 2]), np.array([False, True, False, False, True])
    assert closing_packets(tuples, last, 0, 7, "at_least") == [1, 4]
    assert closing_packets(tuples, last, 2, 5, "exact") == [0]
    assert closing_packets(tuples, last, 0, 0, "last") == [1, 4]


def test_wrong_options():
    for options in ({"size": 0}, {"size": 5, "close": "never"}, {"size": 5, "p": 3}, {"size": 5, "by": ("rank",)}):
        with pytest.raises(ValueError):
            KeyedWindows("x", **options)


def test_counters_can_be_read_while_a_stream_runs(spark):
    inbox, out = new_folder(spark, "inbox"), new_folder(spark, "out")
    counters = StreamCounters().attach(spark)
    try:
        for i in range(3):
            keys = [(k,) for k in range(i * 10, i * 10 + 20)] + [(None,)]
            spark.createDataFrame(keys, "id BIGINT").coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema("id BIGINT").option("maxFilesPerTrigger", 1).parquet(inbox)
        query = keep_counted_registers(stream, out, "id", 12, available_now=False)
        assert counters.wait_for_batch(query, 2)
        assert query.isActive and counters.totals(query.id)[0] == 60
        seen = counters.batches(query.id)
        assert [(b.batch_id, b.keys, b.nulls, b.input_rows) for b in seen] == [(n, 20, 1, 21) for n in range(3)]
        assert all(0 < b.registers <= 20 and b.rows_per_s > 0 and b.mb_per_s > 0 for b in seen)
        query.stop()
        assert counters.wait(query)
    finally:
        counters.detach(spark)
    stored = spark.read.parquet(f"{out}/registers").groupBy("batch_id").count()
    assert rows(stored) == [(b.batch_id, b.registers) for b in seen]
    assert rows(counters.table(spark, query.id).select("batch_id", "keys")) == [(n, 20) for n in range(3)]
