"""Count-based windows over a packet stream, with the payload passed through and the result appended.

Every micro-batch is one batch job.  Packets are numbered and assigned to windows with distributed running sums, so a
session holding most of the traffic is spread over the cluster like any other.  What an open window needs later (its
key and byte counts and its registers) is written next to the results under the batch's own id: a replayed batch reads
the same predecessor and overwrites its own output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.bits import is_not_empty, tuples_in_packet
from ..functions.hashes import get_hash
from ..operators.estimate import estimate_registers
from ..operators.registers import build_registers, check_p, merge_registers
from ..operators.reach import reaching_windows
from ..operators.running import BLOCK_BITS, levels_for
from ..operators.windows import attach_group_value, count_windows, marked_windows, place_packets, window_results
from ..sources.sinks import write_batch
from .registers import start

CLOSE_RULES = ("at_least", "exact", "last")
# The state of an open window enters the next batch as one packet in front of all others.
CARRIED_SEQ = -1


@dataclass(frozen=True)
class PacketWindows:
    """Distinct keys per window of ``size`` keys over packets ``(seq, length, payload, by...)``.

    ``close`` says when a window ends: ``'at_least'`` at the first packet that reaches ``size``, ``'exact'`` only at a
    packet that hits ``size`` exactly (an overshooting window never ends), ``'last'`` at packets whose ``last`` flag is
    set.  ``by`` gives each session its own windows; empty, one window series spans all packets.  ``seq`` must be
    non-negative and grow from batch to batch within a group.

    ``folder`` receives, per ``batch_id``: ``packets`` (every packet with its window and its offset there), ``result``
    (one row per closed window, placed right behind its payload), ``registers``, the state ``counts`` and ``open``, and the steps
    ``numbers`` and ``places`` of narrow rows.
    """

    folder: str
    size: int = 0
    close: str = "at_least"
    by: tuple[str, ...] = ("session_id",)
    p: int = 16
    hash: str = "murmur3_64_h1"
    bits: int = BLOCK_BITS

    def __post_init__(self) -> None:
        check_p(self.p)
        get_hash(self.hash)
        if self.close not in CLOSE_RULES:
            raise ValueError(f"close must be one of {', '.join(CLOSE_RULES)}, got {self.close!r}")
        if self.close != "last" and self.size < 1:
            raise ValueError(f"size must be positive, got {self.size}")

    def start(self, packets: DataFrame, available_now: bool = True) -> StreamingQuery:
        writer = packets.writeStream.foreachBatch(self.process)
        return start(writer, f"{self.folder}/checkpoint", available_now)

    def results(self, spark: SparkSession) -> DataFrame:
        """``(by..., window_id, offset, length, estimate)`` of every window closed so far."""
        return spark.read.parquet(f"{self.folder}/result").drop("batch_id")

    def closed_estimates(self, spark: SparkSession) -> DataFrame:
        """``(by..., window_id, estimate, zeros, harmonic, raw)`` of every window closed so far, from its registers."""
        stored = spark.read.parquet(f"{self.folder}/registers").where("window_closed")
        group = [*self.by, "window_id"]
        return estimate_registers(merge_registers(stored, by=group), self.p, get_hash(self.hash).width, group)

    def payloads(self, spark: SparkSession) -> DataFrame:
        """``(by..., window_id, seq, offset, length, payload)`` of every packet so far."""
        packets = spark.read.parquet(f"{self.folder}/packets").where(F.col("seq") != CARRIED_SEQ)
        return packets.select(*self.by, "window_id", "seq", "offset", "length", "payload")

    def _assign(self, rows: DataFrame, levels: int, batch_id: int) -> DataFrame:
        if self.close == "exact":
            return count_windows(rows, self.size, self.by, self.bits, levels, lambda df: self._write(df, "numbers", batch_id))
        if self.close == "last":
            return marked_windows(rows, self.by, bits=self.bits, levels=levels)
        return reaching_windows(rows, self.size, self.by, self.bits)

    def _carried(self, spark: SparkSession, schema: T.StructType, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """Counts and open registers the previous batch left."""
        keys = [schema[c] for c in self.by]
        counts = T.StructType([
            *keys, T.StructField("windows", T.LongType()), T.StructField("tuples", T.LongType()),
            T.StructField("bytes", T.LongType()),
        ])
        registers = T.StructType(
            [*keys, T.StructField("bucket", T.IntegerType()), T.StructField("rank", T.ByteType())]
        )
        if batch_id == 0:
            return spark.createDataFrame([], counts), spark.createDataFrame([], registers)
        before = f"batch_id={batch_id - 1}"
        return (
            spark.read.schema(counts).parquet(f"{self.folder}/counts/{before}"),
            spark.read.schema(registers).parquet(f"{self.folder}/open/{before}"),
        )

    def _write(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        """Store a step of this batch and go on from the stored table: the plans stay small and nothing runs twice."""
        write_batch(df, f"{self.folder}/{name}", batch_id)
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.folder}/{name}/batch_id={batch_id}")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        by, group = list(self.by), [*self.by, "window_id"]
        counts, open_registers = self._carried(batch.sparkSession, batch.schema, batch_id)
        marker = F.col("last") if self.close == "last" else F.lit(False)
        packets = batch.where(is_not_empty("length")).select(
            *by, F.col("seq").cast("bigint").alias("seq"), F.col("length").cast("bigint").alias("length"),
            F.expr(tuples_in_packet("length")).alias("tuples"), marker.alias("last"),
            F.col("payload").cast("array<bigint>").alias("payload"),
        )
        carried = counts.where("bytes > 0").select(
            *by, F.lit(CARRIED_SEQ).cast("bigint").alias("seq"), F.col("bytes").alias("length"), "tuples",
            F.lit(False).alias("last"), F.lit(None).cast("array<bigint>").alias("payload"),
        )
        levels = levels_for(batch, "seq", self.bits)
        placed = place_packets(
            packets.unionByName(carried), lambda narrow: self._assign(narrow, levels, batch_id), by, self.bits, levels,
            lambda df: self._write(self._numbered(df, counts), "places", batch_id), "last",
        )
        windowed = self._write(placed, "packets", batch_id)

        keys = windowed.select(*group, "window_closed", F.explode("payload").alias("key"))
        fresh = build_registers(keys, "key", self.p, self.hash, [*group, "window_closed"])
        # The window left open by the previous batch is the one its carried packet is in.
        resumed = windowed.where(F.col("seq") == CARRIED_SEQ).select(*group, "window_closed")
        state = F.struct("window_id", "window_closed").alias("state")
        old = attach_group_value(open_registers, resumed.select(*by, state), by, "state", "bucket")
        old = old.select(*by, "state.window_id", "state.window_closed", "bucket", "rank")
        merged = merge_registers(fresh, old, by=[*group, "window_closed"])
        registers = self._write(merged, "registers", batch_id)
        self._write(registers.where("NOT window_closed").select(*by, "bucket", "rank"), "open", batch_id)

        estimates = estimate_registers(registers.where("window_closed"), self.p, get_hash(self.hash).width, group)
        self._write(window_results(windowed, estimates, by), "result", batch_id)

        still_open = F.when(F.col("window_closed"), F.lit(0)).otherwise(F.lit(1))
        zero = F.lit(0).cast("bigint")
        moved = windowed.select(
            *by, F.col("closes").cast("bigint").alias("windows"), (F.col("tuples") * still_open).alias("tuples"),
            (F.col("length") * still_open).alias("bytes"),
        )
        known = counts.select(*by, "windows", zero.alias("tuples"), zero.alias("bytes"))
        totals = [F.coalesce(F.sum(c), zero).alias(c) for c in ("windows", "tuples", "bytes")]
        self._write(moved.unionByName(known).groupBy(*by).agg(*totals), "counts", batch_id)

    def _numbered(self, windowed: DataFrame, counts: DataFrame) -> DataFrame:
        """Turn window numbers of this batch into numbers of the whole stream."""
        known = counts.select(*self.by, F.col("windows").alias("__windows"))
        earlier = attach_group_value(windowed, known, self.by, "__windows")
        number = F.col("window_id") + F.coalesce("__windows", F.lit(0))
        return earlier.withColumn("window_id", number).drop("__windows")
