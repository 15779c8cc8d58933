"""Register tables, estimates and their properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallysketch import Sketch, approx_distinct, build_registers, error_report, estimate_registers
from tallysketch.functions.hashes import register_hash
from tallysketch.operators.cumulative import checkpoints, cumulative_estimates, cumulative_exact
from tallysketch.operators.estimate import refine
from tallysketch.plans.error_curve import error_curve
from tallysketch.plans.measured_run import measured_run
from tallysketch.storage import new_folder


def naturals(spark, n, start=0):
    return spark.range(start, start + n).withColumnRenamed("id", "key")


ESTIMATES = [
    ("MURMUR3_64", 1000, 14, 15420, 15728.8291015625, 993.5238057478365),
    ("MURMUR3_32", 1000, 14, 15416, 15729.645629882812, 997.7744219346037),
    ("SIP", 1000, 14, 15414, 15731.02734375, 999.900143637231),
    ("IDENT", 1000, 14, 16383, 16383.000001907349, 1.0000305188197178),
    ("MURMUR3_64", 100000, 14, 36, 1942.5485610961914, 99667.90418845428),
    ("MURMUR3_32", 100000, 14, 30, 1928.0039520263672, 100419.78579207142),
    ("SIP", 100000, 14, 34, 1914.6246871948242, 101121.51230663307),
    ("MURMUR3_64", 8, 4, 11, 11.8828125, 5.995095191062571),
    ("MURMUR3_64", 100000, 4, 0, 0.001739501953125, 99446.27515929587),
    ("MURMUR3_32", 0, 14, 16384, 16384.0, 0.0),
]


@pytest.mark.parametrize("name,n,p,zeros,harmonic,expected", ESTIMATES)
def test_golden_estimates(spark, name, n, p, zeros, harmonic, expected):
    row = approx_distinct(naturals(spark, n), "key", p, name).first()
    assert (row.zeros, row.harmonic) == (zeros, harmonic)
    assert row.estimate == pytest.approx(expected, rel=1e-12)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_duplicates_order_and_partitions_do_not_matter(spark):
    keys = naturals(spark, 5000)
    base = rows(build_registers(keys, "key", 10))
    assert rows(build_registers(keys.unionByName(keys), "key", 10)) == base
    assert rows(build_registers(keys.orderBy(F.desc("key")).repartition(13), "key", 10)) == base


def test_merge_laws(spark):
    a, b, c = (Sketch.build(naturals(spark, 700, s), "key", 8, "murmur3_64") for s in (0, 500, 4000))
    whole = Sketch.build(naturals(spark, 1200).unionByName(naturals(spark, 700, 4000)), "key", 8, "murmur3_64")
    assert rows(a.merge(b).merge(c).registers) == rows(whole.registers)
    assert rows(a.merge(b.merge(c)).registers) == rows(whole.registers)
    assert rows(b.merge(a).registers) == rows(a.merge(b).registers)
    assert rows(a.merge(a).registers) == rows(a.registers)


def test_merge_and_parameters_are_checked(spark):
    keys = naturals(spark, 10)
    sketch = Sketch.build(keys, "key", 8)
    for other in (Sketch.build(keys, "key", 9), Sketch.build(keys, "key", 8, "SIP")):
        with pytest.raises(ValueError):
            sketch.merge(other)
    for p in (3, 17, "8"):
        with pytest.raises(ValueError):
            Sketch.build(keys, "key", p)
    with pytest.raises(ValueError):
        sketch.roll_up(["day"])
    with pytest.raises(ValueError):
        build_registers(keys, "key", padding="keep")


def test_saved_sketches_reload_and_roll_up(spark):
    keys = naturals(spark, 4000).withColumn("day", F.col("key") % 4).withColumn("kind", F.col("key") % 3)
    keys = keys.withColumn("kind", F.when(F.col("kind") > 0, F.col("kind")))
    path = new_folder(spark, "sketch")
    Sketch.build(keys, "key", 9, by=["day", "kind"]).save(path, ["day"])
    loaded = Sketch.load(spark, path, ["day", "kind"])
    assert (loaded.p, loaded.hash) == (9, "murmur3_32")
    assert rows(loaded.roll_up().registers) == rows(build_registers(keys, "key", 9))
    direct = {r.kind: r.estimate for r in approx_distinct(keys, "key", 9, by=["kind"]).collect()}
    assert {r.kind: r.estimate for r in loaded.roll_up(["kind"]).estimate().collect()} == direct
    assert set(direct) == {None, 1, 2}


def test_padding(spark):
    frame = spark.createDataFrame([(5,), (None,)], "key BIGINT")
    assert build_registers(frame, "key", 8).count() == 1
    zero = build_registers(spark.createDataFrame([(5,), (0,)], "key BIGINT"), "key", 8)
    assert rows(build_registers(frame, "key", 8, padding="as_zero")) == rows(zero)


def test_dense_dump(spark):
    sketch = Sketch.build(naturals(spark, 30), "key", 6)
    dense = [tuple(r) for r in sketch.dense().collect()]
    assert [b for b, _ in dense] == list(range(64))
    assert sorted((b, r) for b, r in dense if r) == rows(sketch.registers)
    assert sketch.zeros().first().zeros == sum(r == 0 for _, r in dense)


def test_wide_ranks_span_both_words(spark):
    """A 128-bit hash made of the key itself: the rank must count zeros past the first word."""
    cases = [(0, 0), (0, 1), (0, -1), (0, 2**62), (5, 7), (1, 0), (2**59, 3)]
    frame = spark.createDataFrame([(i, h, l) for i, (h, l) in enumerate(cases)], "g INT, hi BIGINT, lo BIGINT")
    register_hash("pair", 128, lambda k: k, u32_keys=False)
    keyed = frame.select("g", F.struct("hi", "lo").alias("key"))
    got = {r.g: r["rank"] for r in build_registers(keyed, "key", 4, "pair", ["g"]).collect()}
    for i, (hi, lo) in enumerate(cases):
        rest = ((hi << 64) | (lo & (2**64 - 1))) & (2**124 - 1)
        assert got[i] == 124 - rest.bit_length() + 1
    both = keyed.where("g < 4").select(F.lit(0).alias("g"), "key")
    assert build_registers(both, "key", 4, "pair", ["g"]).first()["rank"] == 125
    assert estimate_registers(build_registers(both, "key", 4, "pair"), 4, 128).first().zeros == 15


def test_large_range_correction(spark):
    frame = spark.createDataFrame([(1e6, 0), (2e8, 0), (2e8, 3), (100.0, 5), (100.0, 0)], "raw DOUBLE, zeros BIGINT")
    m = 16384
    got = [r[0] for r in frame.select(F.expr(refine("raw", "zeros", 14, "hw32"))).collect()]
    big = -(2.0**32) * math.log(1 - 2e8 / 2**32)
    assert got == pytest.approx([1e6, big, big, m * math.log(m / 5), 100.0])
    assert frame.select(F.expr(refine("raw", "zeros", 14))).collect()[1][0] == 2e8


def test_errors_stay_within_three_sigma(spark):
    for name in ("MURMUR3_32", "MURMUR3_64", "murmur3_64_h1", "murmur3_128", "SIP", "xxhash64"):
        for n in (300, 20000, 200000):
            row = error_report(naturals(spark, n), "key", 12, name).first()
            assert row.exact == n
            assert abs(row.error_pct) <= 3 * row.bound_pct, (name, n)
            assert row.out_of_range == (abs(row.error_pct) > row.bound_pct)


def test_error_report_by_group_and_empty(spark):
    frame = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (None, 7), (2, None)], "g INT, key BIGINT")
    got = {r.g: r.exact for r in error_report(frame, "key", by=["g"]).collect()}
    assert got == {1: 2, None: 1, 2: 0}
    empty = error_report(frame.where("false"), "key").first()
    assert (empty.exact, empty.estimate, empty.out_of_range) == (0, 0.0, False)


def test_checkpoint_series():
    series = checkpoints()
    assert series[:5] == [100000, 115478, 133351, 153991, 177826]
    assert (len(series), series[-1]) == (75, 4216855842)


def test_cumulative_equals_direct(spark):
    rng = random.Random(1)
    data = [(rng.randrange(5), rng.randrange(400), rng.choice(["a", None])) for _ in range(1500)]
    frame = spark.createDataFrame(data, "t INT, key BIGINT, g STRING")
    got = {(r.g, r.t): r.estimate for r in cumulative_estimates(frame, "key", "t", 8, "murmur3_64", ["g"]).collect()}
    exact = {(r.g, r.t): r.exact for r in cumulative_exact(frame, "key", "t", ["g"]).collect()}
    for g, t in {(g, t) for t, _, g in data}:
        part = frame.where(F.col("g").eqNullSafe(g) & (F.col("t") <= t))
        assert got[(g, t)] == approx_distinct(part, "key", 8, "murmur3_64").first().estimate
        assert exact[(g, t)] == part.select("key").distinct().count()
    assert len(got) == len(exact) == len({(g, t) for t, _, g in data})


def test_error_curve(spark):
    curve = error_curve(spark, ["MURMUR3_32", "IDENT"], 3000, 10, first=1000).orderBy("cardinality").collect()
    assert [r.cardinality for r in curve] == checkpoints(3000, 1000)
    for row in curve:
        direct = approx_distinct(naturals(spark, row.cardinality), "key", 10).first().estimate
        assert row.MURMUR3_32 == pytest.approx(100 * (direct / row.cardinality - 1))
    drawn = error_curve(spark, ["MURMUR3_32"], 3000, 10, random=True, truth="draws", first=1000).collect()
    assert all(r.cardinality == r.draws for r in drawn)
    with pytest.raises(ValueError):
        error_curve(spark, ["CRC"], 3000)


def test_measured_run(spark):
    row = measured_run(spark, "MURMUR3_32", 1003, 12, partitions=3).first()
    assert (row["keys"], row.exact, row.partitions) == (1003, 1003, 3)
    assert row.estimate == approx_distinct(naturals(spark, 1003), "key", 12).first().estimate
    with pytest.raises(ValueError):
        measured_run(spark, "MURMUR3_32", 8, 17)


def test_groups_without_keys_stay(spark):
    frame = spark.createDataFrame([("a", 5), ("a", None), ("b", None), (None, None)], "g STRING, key BIGINT")
    sketch = Sketch.build(frame, "key", 8, by=["g"])
    assert {r.g: round(r.estimate) for r in sketch.estimate().collect()} == {"a": 1, "b": 0, None: 0}
    assert {r.g: r.zeros for r in sketch.zeros().collect()} == {"a": 255, "b": 256, None: 256}
    assert sketch.roll_up().estimate().first().zeros == 255
    assert sketch.dense().count() == 3 * 256
    assert sketch.histogram().count() == 1


def test_saved_sketches_keep_their_groups(spark, tmp_path):
    rows = [("007", 1), ("7", 2), ("", 3), (None, 4), ("x=y/z", 5)]
    frame = spark.createDataFrame(rows, "g STRING, key BIGINT")
    path = str(tmp_path / "sketch")
    Sketch.build(frame, "key", 8, by=["g"]).save(path, ["g"])
    loaded = Sketch.load(spark, path)
    assert {r.g: round(r.estimate) for r in loaded.estimate().collect()} == {g: 1 for g, _ in rows}
    Sketch.build(frame.withColumn("key", F.col("key") + 10), "key", 8, by=["g"]).save(path, ["g"], "append")
    assert {round(r.estimate) for r in Sketch.load(spark, path).estimate().collect()} == {2}
    with pytest.raises(ValueError):
        Sketch.build(frame, "key", 9, by=["g"]).save(path, ["g"], "append")


def test_empty_sketches_can_be_saved(spark, tmp_path):
    empty = spark.createDataFrame([], "g STRING, key BIGINT")
    Sketch.build(empty, "key", 8, "murmur3_64", by=["g"]).save(str(tmp_path / "empty"), ["g"])
    loaded = Sketch.load(spark, str(tmp_path / "empty"), [])
    assert (loaded.p, loaded.hash, loaded.estimate().first().estimate) == (8, "murmur3_64", 0.0)


def test_wrong_inputs_raise(spark):
    with pytest.raises(TypeError):
        Sketch.build(spark.createDataFrame([(1.2,)], "key DOUBLE"), "key")
    for name in ("bucket", "Rank", "estimate", "word0"):
        with pytest.raises(ValueError):
            Sketch.build(spark.createDataFrame([(1, 2)], f"{name} INT, key INT"), "key", by=[name])
    with pytest.raises(ValueError):
        Sketch.build(spark.range(3), "id", hash="murmur3_64").estimate("hw32")
    with pytest.raises(ValueError):
        register_hash("murmur3_32", 32, lambda k: k)
