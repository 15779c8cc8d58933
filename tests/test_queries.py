"""Every registered query with SQL gives what that SQL gives in another engine."""

import re

import duckdb
import pytest

import __spark_entry__ as driver
import check

QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def other(tables):
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet'")
    return connection


# Queries of subpackages that may be left out have tests of their own beside them.
OWN = [n for n, run in QUERIES.items() if run.__module__.startswith("tallysketch.plans")]


@pytest.mark.parametrize("name", OWN)
def test_query(spark, tables, other, name):
    mine = QUERIES[name](spark, tables).toPandas()
    if name in SQL:
        assert check.compare(mine, other.execute(SQL[name]).df()).startswith("same")
    else:
        assert len(mine) > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_empty_sketches_of_odd_groups(spark, tmp_path):
    rows = [(None, None), (None, 7), ("a", 7), ("a", 8), ("b", None), ("b", None), ("", 9)]
    spark.createDataFrame(rows, "event_type STRING, user_id LONG").write.parquet(str(tmp_path / "events.parquet"))
    other = duckdb.connect()
    other.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    mine = QUERIES["x1_empty_sketch"](spark, str(tmp_path))
    assert check.compare(mine.toPandas(), other.execute(SQL["x1_empty_sketch"]).df()).startswith("same")
    found = {(r.level, r.event_type): (r.estimate, r.rows, r.keys, round(r.merged)) for r in mine.collect()}
    assert found == {
        ("type", None): (0, 2, 1, 1), ("type", "a"): (0, 2, 2, 2), ("type", "b"): (0, 2, 0, 0), ("type", ""): (0, 1, 1, 1),
        ("total", None): (0, 7, 4, 3)}


def test_builtin_counts_keep_sketches_per_flag_only(spark, tmp_path):
    """Flags without a value stay a group, keys may be missing, and no order key has a sketch of its own."""
    rows = [(None, 1), (None, 1), (None, 2), ("A", 3), ("A", None), ("", 3), ("", 4), ("", 5)]
    spark.createDataFrame(rows, "l_returnflag STRING, l_orderkey LONG").write.parquet(str(tmp_path / "lineitem.parquet"))
    mine = QUERIES["a10_builtin_counts"](spark, str(tmp_path))
    assert {tuple(r) for r in mine.collect()} == {(None, 2, True, True), ("A", 1, True, True), ("", 3, True, True)}
    plan = mine._jdf.queryExecution().sparkPlan().toString()
    per_key = [x for x in plan.splitlines() if re.search(r"Aggregate\(.*keys=\[[^]]*l_orderkey", x)]
    assert per_key and "hll_sketch_agg" in plan
    assert not [x for x in per_key if "hll_sketch_agg" in x or "approx_count_distinct" in x]
