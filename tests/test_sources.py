"""Sources, sinks, routing and running aggregates against plain Python."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallysketch import approx_distinct
from tallysketch.operators.routing import merge_by_origin, merge_fair, merge_priority, split_packets
from tallysketch.operators.running import running
from tallysketch.plans.flows import estimate_extent, estimate_runs
from tallysketch.sources.extents import (
    ExtentReader, KeyRanges, Span, matching_parts, plan_spans, read_extent, write_extent,
)
from tallysketch.sources.generators import from_generator, naturals, uniform
from tallysketch.sources.lines import LINE_SCHEMA, count_lane_keys, pack_lines, unpack_lines
from tallysketch.sources.packets import pack_packets, read_packets
from tallysketch.storage import new_folder


def packed(spark, count, width):
    """Lines of the keys 1..count, the last one sent again as the end of the run."""
    keys = spark.range(1, count + 1).select((F.col("id") - 1).alias("o"), F.col("id").alias("key"))
    lines = pack_lines(keys, "o", "key", width).withColumn("last", F.lit(False))
    end = lines.where(F.col("seq") == (count - 1) // width)
    return lines.unionByName(end.withColumn("seq", F.col("seq") + 1).withColumn("last", F.lit(True)))


def test_full_lines(spark):
    row = estimate_runs(packed(spark, 100000, 16)).first()
    assert row.estimate == pytest.approx(100389.71444065128, rel=1e-12)


@pytest.mark.parametrize("padding,expected", [("drop", 10028.627179199386), ("as_zero", 10029.792543331256)])
def test_padded_lines(spark, padding, expected):
    lines = packed(spark, 10000, 10)
    assert estimate_runs(lines, padding=padding).first().estimate == pytest.approx(expected, rel=1e-12)
    assert count_lane_keys(lines.where("NOT last")).first()["keys"] == 10000
    assert unpack_lines(lines.where("NOT last"), ["seq"], "as_zero").count() == 16000


def test_partial_masks_and_null_lanes(spark):
    lines = spark.createDataFrame([(0, [1, None, 3, 4], 0xFFF | 0x7000, True)], LINE_SCHEMA)
    assert [r.key for r in unpack_lines(lines).orderBy("lane").collect()] == [1, 3]
    assert [r.key for r in unpack_lines(lines, ["seq"], "as_zero").orderBy("lane").collect()] == [1, 0, 3, 0]


def test_runs_without_keys_are_kept(spark):
    lines = spark.createDataFrame([(0, [1], 15, True), (1, [1], 0, True), (2, [1], 15, False)], LINE_SCHEMA)
    assert {r.run_id: round(r.estimate) for r in estimate_runs(lines, 8).collect()} == {0: 1, 1: 0}


def test_extent_round_trip(spark):
    path = new_folder(spark, "extent")
    keys = [0, 1, 2**31, 2**32 - 1, *range(100, 600)]
    frame = spark.createDataFrame(list(enumerate(keys)), "o BIGINT, key BIGINT")
    write_extent(frame.orderBy("o").select("key"), path)
    whole = read_extent(spark, path, chunk=100)
    assert [(r.address, r.key) for r in whole.orderBy("address").collect()] == [(4 * i, k) for i, k in enumerate(keys)]
    part = read_extent(spark, path, 8, 4 * 100 + 3, chunk=64).orderBy("address").collect()
    assert [r.key for r in part] == keys[2:102]
    assert read_extent(spark, path, 8, 0).count() == 0
    write_extent(frame.where("o < 5").select("key"), path, "overwrite")
    assert read_extent(spark, path).count() == 5
    result = new_folder(spark, "result")
    estimate_extent(spark, path, result)
    assert round(spark.read.parquet(result).first().estimate) == 5


def test_bad_extent_keys_raise(spark):
    with pytest.raises(Exception, match="inside 0"):
        write_extent(spark.createDataFrame([(2**32,)], "key BIGINT"), new_folder(spark, "extent"))


def test_spans_cover_the_range():
    pieces = [("a", 40), ("b", 0), ("c", 24), ("d", 7)]
    for offset, length in [(0, None), (8, 50), (40, 24), (60, 11), (0, 3), (68, 100)]:
        spans = plan_spans(pieces, offset, length, 12)
        end = min(71, offset + length) if length is not None else 71
        end -= (end - offset) % 4 if end > offset else 0
        assert sum(s.size for s in spans) == max(0, end - offset)
        assert all(s.size <= 12 and s.size % 4 == 0 and s.start + s.size <= dict(pieces)[s.file] for s in spans)
        assert [s.address for s in spans] == sorted(s.address for s in spans)
    with pytest.raises(ValueError):
        plan_spans(pieces, 2, None, 12)


def test_generators_do_not_depend_on_partitions(spark):
    assert sorted(uniform(spark, 500, 7, 1).collect()) == sorted(uniform(spark, 500, 7, 9).collect())
    assert uniform(spark, 500, 7).join(uniform(spark, 500, 8), ["draw", "key"]).count() < 5
    assert [r.key for r in naturals(spark, 4, 3).orderBy("key").collect()] == [3, 4, 5, 6]
    squares = from_generator(spark, 100, lambda i: i * i, 5)
    assert sorted(r.key for r in squares.collect()) == [i * i for i in range(100)]


def test_packets(spark):
    keys = spark.range(1, 10001).select((F.col("id") - 1).alias("o"), F.col("id").alias("key"))
    path = new_folder(spark, "packets")
    pack_packets(keys, "o", "key", 350, F.lit(13)).write.parquet(path)
    packets = read_packets(spark, path)
    assert packets.agg(F.max("length"), F.sum("length")).first() == (1400, 40000)
    estimate = approx_distinct(packets.select(F.explode("payload").alias("key")), "key", 16, "murmur3_64_h1").first()
    assert estimate.estimate == pytest.approx(10028.627179199386, rel=1e-12)


@pytest.mark.parametrize("levels,bits", [(1, 3), (2, 2), (3, 1), (1, 16)])
@pytest.mark.parametrize("kind,inclusive", [("sum", True), ("sum", False), ("max", True), ("max", False)])
def test_running_aggregates(spark, levels, bits, kind, inclusive):
    rng = random.Random(levels)
    data = [(o, rng.choice(["a", "b", None]), rng.choice([None, *range(9)])) for o in rng.sample(range(200), 60)]
    frame = spark.createDataFrame(data, "o BIGINT, g STRING, v BIGINT")
    got = running(frame, "o", {"x": F.col("v"), "n": F.lit(1)}, ["g"], kind, inclusive, 0, bits, levels)
    state = {}
    expected = []
    for o, g, v in sorted(data, key=lambda r: r[0]):
        x, n = state.get(g, (0, 0))
        after = (x + (v or 0), n + 1) if kind == "sum" else (max(x, v or 0), 1)
        expected.append((o, *(after if inclusive else (x, n))))
        state[g] = after
    assert [tuple(r) for r in got.orderBy("o").select("o", "x", "n").collect()] == expected


def test_running_rejects_missing_order(spark):
    with pytest.raises(Exception, match="must not be NULL"):
        running(spark.createDataFrame([(None, 1)], "o BIGINT, v BIGINT"), "o", {"x": F.col("v")}).collect()


def test_routing(spark):
    a = spark.createDataFrame([(i, 10 + i, i % 2 == 1) for i in range(6)], "seq BIGINT, key BIGINT, last BOOLEAN")
    b = spark.createDataFrame([(i, 20 + i, True) for i in range(4)], "seq BIGINT, key BIGINT, last BOOLEAN")

    def keys(df, *order):
        return [r.key for r in df.orderBy(*order).collect()]

    assert keys(merge_priority(a, b), "source", "seq") == [10, 11, 12, 13, 14, 15, 20, 21, 22, 23]
    assert keys(merge_fair(a, b, bits=1), "turn", "source") == [10, 20, 11, 21, 12, 22, 13, 23, 14, 15]
    assert keys(merge_fair(a, b, True, 1), "turn", "source", "seq") == [10, 11, 20, 12, 13, 21, 14, 15, 22, 23]
    origin = spark.createDataFrame([(i, s) for i, s in enumerate([1, 1, 0, 1, 0])], "position BIGINT, source INT")
    assert keys(merge_by_origin(origin, a, b, bits=1), "position") == [20, 21, 10, 22, 11]
    assert keys(merge_by_origin(origin, a, b, True, 1), "position", "seq") == [20, 21, 10, 11, 22, 12, 13]
    flags = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "packet BIGINT, dest INT")
    first, second = split_packets(a, flags, 1)
    assert (keys(first, "seq"), keys(second, "seq")) == ([12, 13], [10, 11, 14, 15])


def test_key_ranges_do_not_depend_on_batches():
    keys = np.random.default_rng(1).integers(0, 1 << 32, 1000)
    whole = KeyRanges(64)
    whole.add(keys)
    for sizes in ([1] * 1000, [7] * 143, [16] * 63, [500, 0, 500]):
        pieces, at = KeyRanges(64), 0
        for size in sizes:
            pieces.add(keys[at : at + size])
            at += size
        assert pieces.to_bytes() == whole.to_bytes()
    assert whole.low == [int(keys[i : i + 16].min()) for i in range(0, 1000, 16)]
    assert whole.high == [int(keys[i : i + 16].max()) for i in range(0, 1000, 16)]
    assert KeyRanges(64).to_bytes()[8:] == bytes(8)


def test_parts_of_a_span_in_wanted_steps():
    span = Span("f", 24, 100, 1024)
    wanted = np.array([True, False, True, True, False, False, False, True, True])
    assert matching_parts(span, 16, wanted) == [Span("f", 32, 32, 1032), Span("f", 112, 12, 1112)]
    assert matching_parts(span, 16, np.zeros(9, bool)) == []
    assert matching_parts(span, 16, np.ones(9, bool)) == [span]


def test_wanted_keys_choose_what_is_planned(spark):
    path = new_folder(spark, "extent")
    write_extent(spark.range(0, 10_000, 1, 4).select(F.col("id").alias("key")), path, step=400)
    write_extent(spark.range(50, 60).select(F.col("id").alias("key")).coalesce(1), path, step=400)

    def planned(low, high, offset=0, length=None):
        return [(s.address, s.size) for s in ExtentReader(path, offset, length, 1 << 20, low, high).partitions()]

    assert planned(130, 199) == [(400, 400)]
    assert planned(55, 55) == [(0, 400), (40_000, 40)]
    assert planned(99, 100) == [(0, 800), (40_000, 40)][:1]
    assert planned(130, 199, 500, 100) == [(500, 100)]
    assert planned(10_000, 1 << 33) == planned(7, 6) == []
    assert sum(size for _, size in planned(0, 1 << 32)) == 40_040

    extent = read_extent(spark, path, lowest_key=40, highest_key=58)
    assert extent.count() == 19 + 9
    # One DataFrame, several filters: each sees all rows.
    assert extent.where("key = 55").unionByName(extent.where("key <> 55")).count() == 28
    assert extent.rdd.getNumPartitions() == 2 < read_extent(spark, path).rdd.getNumPartitions()
    assert read_extent(spark, path, lowest_key=20_000).count() == 0
    part = read_extent(spark, path, 404, 4000, highest_key=149)
    assert sorted(tuple(r) for r in part.collect()) == [(4 * i, i) for i in range(101, 150)]


def test_files_without_fitting_ranges_are_read_whole(spark):
    path = new_folder(spark, "extent")
    write_extent(spark.range(100).select(F.col("id").alias("key")).coalesce(1), path, step=40)
    (data,) = Path(path.removeprefix("file:")).glob("*.u32")
    data.write_bytes(np.arange(500, 620, dtype="<u4").tobytes())
    assert read_extent(spark, path, lowest_key=510, highest_key=510).count() == 1
    write_extent(spark.range(5).select(F.col("id").alias("key")), path, "overwrite")
    assert read_extent(spark, path, lowest_key=1).count() == 4
    assert not data.exists() and not Path(f"{data}.ranges").exists()
