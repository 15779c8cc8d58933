"""Registered queries: each reads whole tables, and most carry the SQL another engine can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lines import pack_lines
from ..sources.packets import pack_packets
from ..sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

KEYS_PER_LINE = 10
LINES_PER_RUN = 100
KEYS_PER_PACKET = 35
SESSIONS = 3


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name (or ``name``), with its check."""

    def add(fn: Query) -> Query:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return add


def rounded(column: str | Column, places: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, places)


# Lines and packets are cut from the events table in event order: user ids are the keys.


def event_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of ten used lanes out of sixteen; every hundredth line ends a run."""
    events = read_table(spark, folder, "events").select("event_id", "user_id")
    lines = pack_lines(events, "event_id", "user_id", KEYS_PER_LINE)
    return lines.withColumn("last", F.col("seq") % LINES_PER_RUN == LINES_PER_RUN - 1)


def event_packets(spark: SparkSession, folder: str) -> DataFrame:
    """Packets of thirty-five keys from three sessions in turn; every seventh is marked ``last``."""
    events = read_table(spark, folder, "events").select("event_id", "user_id")
    packets = pack_packets(events, "event_id", "user_id", KEYS_PER_PACKET, F.col("seq") % SESSIONS)
    return packets.withColumn("last", F.col("seq") % 7 == 6)


LINES_SQL = f"""lines AS MATERIALIZED (
  SELECT event_id // {KEYS_PER_LINE} AS seq, event_id % {KEYS_PER_LINE} AS lane, user_id AS key,
    (event_id // {KEYS_PER_LINE}) % {LINES_PER_RUN} = {LINES_PER_RUN - 1} AS last FROM events)"""

PACKETS_SQL = f"""packets AS MATERIALIZED (
  SELECT event_id // {KEYS_PER_PACKET} AS seq, CAST((event_id // {KEYS_PER_PACKET}) % {SESSIONS} AS INTEGER) AS session_id,
    CAST(4 * count(*) AS BIGINT) AS length, CAST(count(*) AS BIGINT) AS tuples,
    (event_id // {KEYS_PER_PACKET}) % 7 = 6 AS last
  FROM events GROUP BY ALL)"""
