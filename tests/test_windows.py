"""Packet windows against a plain loop, batch and stream."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallysketch.operators.reach import closing_packets, reaching_windows, summarise
from tallysketch.operators.registers import build_registers
from tallysketch.operators.windows import (
    _closed_windows, count_windows, estimate_windows, marked_windows, payload_offsets, place_packets, run_ids,
)
from tallysketch.operators.estimate import estimate_registers
from tallysketch.sources.packets import PACKET_SCHEMA, stream_packets
from tallysketch.storage import new_folder
from tallysketch.streaming.windows import PacketWindows

SCHEMA = PACKET_SCHEMA + ", last BOOLEAN"


def make_packets(seed, count, sessions, lengths):
    rng = random.Random(seed)
    rows = []
    for seq in range(count):
        length = rng.choice(lengths)
        payload = [rng.randrange(1 << 32) for _ in range(length // 4)]
        rows.append((seq * 3, rng.randrange(sessions), length, 1, 2, False, payload, rng.random() < 0.2))
    return rows


def walk(rows, size, close, by_session=True):
    """The window rules as a state machine; yields (session, window, seq, offset, closes) and closed windows' keys."""
    state = collections.defaultdict(lambda: {"count": 0, "window": 1, "offset": 0, "keys": set()})
    placed, closed = [], {}
    for seq, session, length, _, _, _, payload, last in rows:
        if length == 0:
            continue
        group = session if by_session else None
        s = state[group]
        s["count"] += length // 4
        s["keys"].update(payload)
        hit = {"exact": s["count"] == size, "at_least": s["count"] >= size, "last": last}[close]
        placed.append((group, s["window"], seq, s["offset"], hit))
        s["offset"] += length
        if hit:
            closed[(group, s["window"])] = (s["offset"], s["keys"])
            state[group] = {"count": 0, "window": s["window"] + 1, "offset": 0, "keys": set()}
    return sorted(placed, key=str), closed


@pytest.mark.parametrize("by", [["session_id"], []])
@pytest.mark.parametrize("size,lengths", [(12, [4, 8, 16, 0, 3]), (2, [4, 8, 5]), (1, [4, 2]), (1000, [4])])
def test_count_windows_matches_the_state_machine(spark, by, size, lengths):
    rows = make_packets(size, 150, 3, lengths)
    frame = spark.createDataFrame(rows, SCHEMA)
    windowed = payload_offsets(count_windows(frame, size, by, bits=3), by, bits=3)
    group = F.col("session_id") if by else F.lit(None)
    got = windowed.select(group, "window_id", "seq", "offset", "closes").collect()
    expected, _ = walk(rows, size, "exact", bool(by))
    assert sorted((tuple(r) for r in got), key=str) == expected


@pytest.mark.parametrize("by,bits", [(["session_id"], 2), ([], 3), (["session_id"], 16)])
@pytest.mark.parametrize("size,lengths", [(12, [4, 8, 16, 0, 3]), (1, [4, 2]), (100, [40, 4, 7])])
def test_reaching_windows_match_the_state_machine(spark, by, bits, size, lengths):
    rows = make_packets(size, 150, 3, lengths)
    windowed = reaching_windows(spark.createDataFrame(rows, SCHEMA), size, by, bits)
    group = F.col("session_id") if by else F.lit(None)
    expected, closed = walk(rows, size, "at_least", bool(by))
    got = sorted((tuple(r) for r in windowed.select(group, "window_id", "seq", "closes", "window_closed").collect()), key=str)
    assert got == [(g, w, s, c, (g, w) in closed) for g, w, s, _, c in expected]


def test_block_summaries():
    rng = np.random.default_rng(2)
    for size in (1, 3, 10, 50):
        for _ in range(40):
            tuples = rng.integers(0, 6, rng.integers(1, 30))
            reach, closes, left, total = summarise(tuples, size)
            for held in range(size):
                closing = closing_packets(tuples, size, held)
                count, state = 0, held
                for t in tuples:
                    state += int(t)
                    if state >= size:
                        count, state = count + 1, 0
                assert len(closing) == count
                at = int(np.searchsorted(reach, size - held))
                got = (closes[at], left[at]) if at < len(reach) else (0, held + total)
                assert got == (count, state)


def test_marked_windows_and_run_ids(spark):
    rows = make_packets(5, 120, 3, [4, 8])
    frame = spark.createDataFrame(rows, SCHEMA)
    got = marked_windows(frame, ["session_id"], bits=2).select("session_id", "window_id", "seq", "closes").collect()
    expected, _ = walk(rows, 0, "last")
    assert sorted((tuple(r) for r in got), key=str) == [(g, w, s, c) for g, w, s, _, c in expected]
    runs = {r.seq: r.run_id for r in run_ids(frame, bits=4).collect()}
    count = 0
    for row in rows:
        assert runs[row[0]] == count
        count += row[-1]


def test_null_sessions_are_kept(spark):
    rows = [(i, None if i % 2 else 7, 4, 0, 0, False, [i], False) for i in range(20)]
    for assign in (count_windows, reaching_windows):
        windowed = assign(spark.createDataFrame(rows, SCHEMA), 5, ["session_id"], bits=1)
        assert windowed.count() == 20
        closes = windowed.where("closes").groupBy("session_id").count().orderBy("session_id")
        assert closes.collect() == [(None, 2), (7, 2)]


def test_window_estimates_equal_direct_sketches(spark):
    rows = make_packets(9, 100, 2, [4, 8])
    windowed = count_windows(spark.createDataFrame(rows, SCHEMA), 1, ["session_id"], bits=4)
    estimates = estimate_windows(windowed, 10, "murmur3_32", ["session_id"]).count()
    _, closed = walk(rows, 1, "exact")
    assert estimates == len(closed)


def stream_result(spark, rows, batches, window):
    inbox = new_folder(spark, "inbox")
    size = -(-len(rows) // batches)
    for i in range(batches):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(SCHEMA).parquet(inbox)
        # Every step is a new query on the same checkpoint: a restart after each batch.
        window.start(stream).awaitTermination()
    return window.results(spark), window.payloads(spark)


@pytest.mark.parametrize(
    "close,size,by",
    [("exact", 6, ["session_id"]), ("at_least", 9, ["session_id"]), ("last", 0, ["session_id"]), ("exact", 4, []), ("at_least", 7, [])],
)
def test_stream_windows_match_the_state_machine(spark, close, size, by):
    rows = make_packets(size + 1, 80, 2, [4, 8, 12, 0, 6] if close != "exact" else [4, 4, 8, 0, 2])
    window = PacketWindows(new_folder(spark, "windows"), size, close, tuple(by), 8, "murmur3_32", bits=3)
    results, payloads = stream_result(spark, rows, 2, window)
    expected, closed = walk(rows, size, close, bool(by))
    group = F.col("session_id") if by else F.lit(None).cast("int")
    placed = payloads.select(group, "window_id", "seq", "offset").collect()
    assert sorted((tuple(r) for r in placed), key=str) == [r[:4] for r in expected]
    got = {(r[0], r.window_id): (r.offset, r.estimate) for r in results.select(group, "window_id", "offset", "estimate").collect()}
    assert got.keys() == closed.keys()
    for key, (end, keys) in closed.items():
        frame = spark.createDataFrame([(k,) for k in keys] or [(None,)], "key bigint")
        direct = estimate_registers(build_registers(frame, "key", 8, "murmur3_32"), 8, 32).first().estimate
        assert got[key] == (end, direct)


@pytest.mark.parametrize("by", [["session_id"], []])
@pytest.mark.parametrize("size", [3, 40, 300, 10**6])
def test_reaching_windows_over_several_levels(spark, by, size):
    """Sparse sequence numbers in tiny blocks: summaries are combined over levels, windows span many blocks."""
    rows = [(r[0] * 1000, *r[1:]) for r in make_packets(size, 150, 2, [4, 8, 16, 3])]
    frame = spark.createDataFrame(rows, SCHEMA)
    windowed = reaching_windows(frame, size, by, bits=3)
    group = F.col("session_id") if by else F.lit(None)
    got = windowed.select(group, "window_id", "seq", "closes").collect()
    expected, closed = walk(rows, size, "at_least", bool(by))
    assert sorted((tuple(r) for r in got), key=str) == [(g, w, s, c) for g, w, s, _, c in expected]
    assert windowed.where("window_closed").select(group, "window_id").distinct().count() == len(closed)


@pytest.mark.parametrize("bad", [[1, 1], [1, None]])
def test_sequence_numbers_must_be_usable(spark, bad):
    frame = spark.createDataFrame([(s, 1, 4, 1, 2, False, [s], False) for s in [0, 2, *bad]], SCHEMA)
    for assign in (reaching_windows, count_windows):
        with pytest.raises(Exception, match="unique|NULL"):
            assign(frame, 2, ["session_id"]).collect()


@pytest.mark.parametrize("by", [["session_id"], []])
def test_payloads_are_shuffled_once(spark, by):
    rows = make_packets(3, 200, 3, [4, 8, 0])
    frame = spark.createDataFrame(rows, SCHEMA)
    seen = []

    def assign(narrow):
        seen.append(set(narrow.columns))
        return count_windows(narrow, 2, by, bits=3)

    placed = place_packets(frame, assign, by, bits=3)
    assert seen == [{*by, "seq", "length", "tuples"}]
    got = placed.select(F.col("session_id") if by else F.lit(None), "window_id", "seq", "offset", "closes").collect()
    assert sorted((tuple(r) for r in got), key=str) == walk(rows, 2, "exact", bool(by))[0]
    plan = placed._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1 and "Window" not in plan


def test_series_of_windows_end_at_the_first_gap(spark):
    numbers = {"none": [], "late": [2, 3], "gap": [1, 2, 3, 4, 5, 7, 8], "block": list(range(1, 17)) + [21], None: [1, 2, 3, 4, 9]}
    rows = [(g, n) for g, many in numbers.items() for n in many]
    closed = _closed_windows(spark.createDataFrame(rows, "g STRING, __number BIGINT"), ["g"], 2)
    assert {r.g: r["__closed"] for r in closed.collect()} == {"gap": 5, "block": 16, None: 4}
