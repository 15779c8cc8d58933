"""Two-pass scans, bitmaps and packed sketches against plain Python and the register tables."""

import datetime
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallysketch import Sketch
from tallysketch.functions.tables import register_table_functions
from tallysketch.operators.bitmap import build_bitmaps, count_bitmaps, merge_bitmaps
from tallysketch.operators.packed import EIGHT, SIX, SPARSE, estimate_packed, merge_packed, pack, pack_registers, unpack
from tallysketch.operators.scan import scan


def first_none(value):
    return (value is not None, value)


def scanned(rows, by, order, kind, inclusive):
    """(row id, running value) for rows (id, group, order, value)."""
    out = []
    for i, *_ in rows:
        me = next(r for r in rows if r[0] == i)
        before = [r for r in rows if (not by or r[1] == me[1]) and (
            first_none(r[2]) <= first_none(me[2]) if inclusive else first_none(r[2]) < first_none(me[2]))]
        values = [r[3] for r in before if r[3] is not None]
        out.append((i, sum(values) if kind == "sum" else max(values, default=None)))
    return sorted(out)


@pytest.mark.parametrize("kind", ["sum", "max"])
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("partitions", [1, 7])
def test_scan_is_a_window(spark, kind, inclusive, by, partitions):
    rng = random.Random(1)
    start = datetime.datetime(2024, 1, 1)
    rows = [
        (i, rng.choice(["a", "a", "a", "b", None, ""]), rng.choice([None, start + datetime.timedelta(0, rng.randrange(40))]),
         rng.choice([None, -3, 0, 5, 2 ** 40])) for i in range(120)
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "id BIGINT, g STRING, t TIMESTAMP, v BIGINT, total STRING")
    found = scan(frame, ["t"], {"total": F.col("v")}, by, kind, inclusive, partitions)
    assert found.columns == ["id", "g", "t", "v", "total"]
    assert sorted((r.id, r.total) for r in found.collect()) == scanned(rows, by, "t", kind, inclusive)


def test_scan_in_small_batches(spark):
    """Peers and groups that batches cut; one group over all partitions; two values and two order columns at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(i, "one" if i < 90 else "two", float(i % 4), i % 2, i) for i in range(100)]
        frame = spark.createDataFrame(rows, "id BIGINT, g STRING, t DOUBLE, u INT, v BIGINT")
        found = scan(frame, ["t", "u"], {"a": F.col("v"), "b": F.lit(1)}, ["g"], partitions=5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for r in found:
        before = [x for x in rows if x[1] == r.g and (x[2], x[3]) <= (r.t, r.u)]
        assert (r.a, r.b) == (sum(x[4] for x in before), len(before))


def test_scan_of_odd_orders(spark):
    rows = [(0, float("nan")), (1, float("nan")), (2, None), (3, 1.5), (4, -0.0), (5, float("inf"))]
    frame = spark.createDataFrame(rows, "id INT, t DOUBLE")
    found = {r.id: r.n for r in scan(frame, ["t"], {"n": F.lit(1)}, partitions=3).collect()}
    assert found == {2: 1, 4: 2, 3: 3, 5: 4, 0: 6, 1: 6}
    assert scan(frame.where("id > 9"), ["t"], {"n": F.lit(1)}).collect() == []
    with pytest.raises(ValueError):
        scan(frame, [], {"n": F.lit(1)})
    with pytest.raises(ValueError):
        scan(frame, ["t"], {"n": F.lit(1)}, kind="min")


def test_scan_shuffles_its_rows_once(spark):
    frame = spark.range(1000).withColumn("v", F.col("id"))
    plan = scan(frame, ["id"], {"total": F.col("v")})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange rangepartitioning" not in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


# Bitmaps


def test_bitmaps_are_exact_and_roll_up(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(3), rng.choice([None, 0, 2 ** 32 - 1, 32768, rng.randrange(100_000)]))
            for _ in range(3000)] + [("none", 0, None)]
    table = build_bitmaps(spark.createDataFrame(rows, "g STRING, h INT, key BIGINT"), "key", ["g", "h"])
    for by, pick in ((["g", "h"], lambda r: r[:2]), (["g"], lambda r: r[:1]), ([], lambda r: ())):
        truth = {}
        for r in rows:
            truth.setdefault(pick(r), set()).update([r[2]] if r[2] is not None else [])
        found = {tuple(r)[:-1]: r.exact for r in count_bitmaps(merge_bitmaps(table, table, by=by), by).collect()}
        assert found == {group: len(keys) for group, keys in truth.items()}


def test_bitmaps_of_nothing_and_of_wrong_keys(spark):
    empty = build_bitmaps(spark.createDataFrame([], "key BIGINT"), "key")
    assert count_bitmaps(empty).first().exact == 0
    for key in (-1, 2 ** 32):
        with pytest.raises(Exception, match="must be between"):
            build_bitmaps(spark.createDataFrame([(key,)], "key BIGINT"), "key").collect()


# Packed sketches


@settings(max_examples=60, deadline=None)
@given(st.integers(4, 10), st.integers(0, 1024), st.sampled_from([63, 125]), st.randoms())
def test_packing_is_lossless(p, used, largest, rng):
    registers = np.zeros(1 << p, np.uint8)
    for _ in range(used):
        registers[rng.randrange(1 << p)] = rng.randrange(1, largest + 1)
    raw = pack(registers)
    assert (unpack(raw, p) == registers).all() and len(raw) <= 1 + (1 << p)


def test_packed_forms():
    few = np.zeros(1 << 12, np.uint8)
    few[7] = 3
    full = np.full(1 << 12, 9, np.uint8)
    wide = np.full(1 << 12, 70, np.uint8)
    assert [pack(r)[0] for r in (few, full, wide)] == [SPARSE, SIX, EIGHT]
    assert [len(pack(r)) for r in (few, full, wide)] == [4, 1 + 3 * 1024, 4097]


@pytest.mark.parametrize("hash", ["murmur3_32", "murmur3_128", "xxhash64"])
def test_packed_estimates_equal_register_estimates(spark, hash):
    rows = spark.range(4000).select(
        (F.col("id") * 7919 % 3000).alias("key"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), (F.col("id") % 10).alias("day"))
    rows = rows.unionByName(spark.createDataFrame([(None, 77, 0)], "key BIGINT, g BIGINT, day BIGINT"))
    sketch = Sketch.build(rows, "key", 10, hash, ["g", "day"])
    packed = pack_registers(sketch.registers, 10, ["g", "day"])
    for by in (["g", "day"], ["g"], []):
        mine = estimate_packed(merge_packed(packed, packed, p=10, by=by), 10, hash, by)
        key = lambda r: repr(tuple(r))
        assert sorted(mine.collect(), key=key) == sorted(sketch.roll_up(by).estimate().collect(), key=key)


def test_table_function(spark):
    register_table_functions(spark)
    rows = spark.range(2000).select((F.col("id") % 700).alias("key"), (F.col("id") % 2).alias("g"))
    sketch = Sketch.build(rows, "key", 8, by=["g"])
    sketch.registers.createOrReplaceTempView("regs")
    pack_registers(sketch.registers, 8, ["g"]).createOrReplaceTempView("sketches")
    truth = {r.g: (round(r.estimate, 6), r.zeros, round(r.harmonic, 6)) for r in sketch.estimate().collect()}
    for table in ("regs", "sketches"):
        found = spark.sql(f"SELECT * FROM tally_sketch(TABLE({table}) PARTITION BY (g), 8, 'estimate')").collect()
        assert {r.g: (round(r.estimate, 6), r.zeros, round(r.harmonic, 6)) for r in found} == truth
        counts = spark.sql(f"SELECT * FROM tally_sketch(TABLE({table}) PARTITION BY (g), 8, 'histogram')").collect()
        assert sorted(map(tuple, counts)) == sorted(map(tuple, sketch.histogram().select("g", "rank", "registers").collect()))
    for wrong in ("TABLE(SELECT 1 AS x), 8, 'estimate'", "TABLE(regs), 3, 'estimate'", "TABLE(regs), 8, 'sum'"):
        with pytest.raises(Exception):
            spark.sql(f"SELECT * FROM tally_sketch({wrong})").collect()
