"""Packets of keys: ``(seq, session_id, length, ip, port, closed, payload)``, one row per packet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import KEY_BYTES

PACKET_SCHEMA = (
    "seq BIGINT, session_id INT, length INT, ip BIGINT, port INT, closed BOOLEAN, payload ARRAY<BIGINT>"
)


def pack_packets(
    keys: DataFrame, order: str, key: str, per_packet: int, session: Column, ip: int = 0x01010101, port: int = 0x1389
) -> DataFrame:
    """Cut keys with unique integer order values into packets of up to ``per_packet`` consecutive values.

    ``session`` is an expression over the packet's ``seq``.  A packet holds at most ``per_packet`` keys.
    """
    if per_packet < 1:
        raise ValueError(f"per_packet must be positive, got {per_packet}")
    item = F.struct(F.col(order).alias("o"), F.col(key).cast("bigint").alias("k"))
    seq = F.call_function("div", F.col(order), F.lit(per_packet).cast("bigint")).alias("seq")
    grouped = keys.groupBy(seq).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.select(
        "seq",
        session.cast("int").alias("session_id"),
        (F.size("items") * KEY_BYTES).alias("length"),
        F.lit(ip).cast("bigint").alias("ip"),
        F.lit(port).alias("port"),
        F.lit(False).alias("closed"),
        F.transform("items", lambda x: x["k"]).alias("payload"),
    )


def read_packets(spark: SparkSession, folder: str, format: str = "parquet") -> DataFrame:
    return spark.read.schema(PACKET_SCHEMA).format(format).load(folder)


def stream_packets(
    spark: SparkSession, folder: str, format: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Packets as they arrive in a folder; ``files_per_batch`` bounds a micro-batch (backpressure)."""
    reader = spark.readStream.schema(PACKET_SCHEMA).format(format)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)
