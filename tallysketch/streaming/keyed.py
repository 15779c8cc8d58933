"""Count windows held as keyed state: one small state per session on the RocksDB store, gone when the session is.

A session's state is its counts and the registers of its open window. A window's result comes out in the batch that closes
it, the registers start empty again, and a packet that says ``closed`` ends the session: its state is removed, and packets
that come later with its id begin a new one. ``idle`` also removes sessions that have been silent for so long.

Keys are hashed and ranked before they reach the state, in generated code; the processor folds small integers. It holds the
keys that one batch brings for one session, so bound a batch at the source where a session can bring very many. For
windows over a single series of everything, or with the payload passed through, see ``windows.PacketWindows``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.bits import bit_length, bucket_of, is_not_empty, rank_of, rest_of, tuples_in_packet
from ..functions.hashes import HashFunction, get_hash, hash_keys
from ..functions.u64 import step
from ..operators.estimate import finish, words_for
from ..operators.packed import pack, register_words, unpack
from ..operators.registers import check_groups, check_p, register_count
from ..operators.windows import RESULT_BYTES
from ..sources.sinks import write_batch
from .registers import start
from .windows import CLOSE_RULES

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# Batches without data would follow each other for ever while a stream with time limits is to end at its input's end.
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_PROGRESS = "opened long, windows long, tuples long, bytes long"


def closing_packets(tuples: np.ndarray, last: np.ndarray, held: int, size: int, close: str) -> list[int]:
    """Places of the packets that end a window, with ``held`` keys in the open one before the first packet."""
    if close == "last":
        return np.flatnonzero(last).tolist()
    ends = []
    for place, count in enumerate(tuples.tolist()):
        held += count
        if held >= size if close == "at_least" else count and held == size:
            ends.append(place)
            held = 0
    return ends


def ranked_keys(rows: DataFrame, key: str, p: int, hash: str | HashFunction) -> DataFrame:
    """Replace the key column by its ``bucket`` and ``rank``; a NULL key has bucket -1."""
    spec = get_hash(hash)
    hashed = hash_keys(rows, key, spec, "__hash", keep_nulls=True)
    if spec.width < 128:
        bucket, rank = bucket_of("__hash", spec.width, p), rank_of("__hash", spec.width, p)
    else:
        rest = rest_of("__hash.hi", 64, p)
        bucket = bucket_of("__hash.hi", 64, p)
        rank = f"CASE WHEN {rest} = 0 THEN {129 - p} - {bit_length('__hash.lo')} ELSE {65 - p} - {bit_length(rest)} END"
    known = f"`{key}` IS NOT NULL"
    told = step(hashed, bucket=f"CASE WHEN {known} THEN {bucket} ELSE -1 END", rank=f"CAST(CASE WHEN {known} THEN {rank} ELSE 0 END AS INT)")
    return told.drop(key, "__hash")


def _key_text(column: str, kind: T.DataType) -> Column:
    """A group value as text that is never NULL: keyed state does not tell NULLs from other values."""
    value = F.unix_micros(column) if isinstance(kind, T.TimestampType) else F.col(column)
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def _key_value(text: str, kind: T.DataType) -> Column:
    value = F.when(F.col(text) != "", F.substring(text, 2, 2 ** 31 - 1))
    return F.timestamp_micros(value.cast("bigint")) if isinstance(kind, T.TimestampType) else value.cast(kind)


class _Session(StatefulProcessor):
    """Folds one session's packets; emits ``opened, window_id, offset, nonempty, word0..`` for each window it closes."""

    def __init__(self, by: list[str], size: int, close: str, p: int, words: int, idle_ms: int | None) -> None:
        self.by, self.size, self.close_rule, self.p, self.words, self.idle = by, size, close, p, words, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getValueState("progress", _PROGRESS, self.idle)
        self.registers = handle.getValueState("registers", "packed binary", self.idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # pandas is what the API hands over; everything below works on its arrays.
        frame = pd.concat(rows, ignore_index=True).sort_values("seq", kind="stable")
        seq, bucket, rank = (frame[name].to_numpy() for name in ("seq", "bucket", "rank"))
        first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
        bounds = np.append(first, len(seq))
        packets = {name: frame[name].to_numpy()[first] for name in ("tuples", "length", "last", "closed")}
        results, begin = [], 0
        for end in [*(np.flatnonzero(packets["closed"]) + 1).tolist(), len(first)]:
            if begin == end:
                continue
            part = slice(begin, end)
            own = slice(bounds[begin], bounds[end])
            results += self._advance(
                seq[first[part]], {name: values[part] for name, values in packets.items()},
                bounds[begin:end + 1] - bounds[begin], bucket[own], rank[own])
            if packets["closed"][end - 1]:
                self.progress.clear()
                self.registers.clear()
            begin = end
        if not results:
            return
        names = ["opened", "window_id", "offset", "nonempty", *(f"word{i}" for i in range(self.words))]
        out = pd.DataFrame(results, columns=names, dtype=np.int64)
        for place, name in enumerate(self.by):
            out.insert(place, name, [key[place]] * len(out))
        yield out

    def _advance(self, seq, packets, bounds, bucket, rank) -> list[tuple]:
        """Take packets of one session up to its end or the batch's, and store what is open then."""
        opened, windows, held, size = self.progress.get() or (int(seq[0]), 0, 0, 0)
        stored = self.registers.get()
        registers = unpack(bytes(stored[0]), self.p) if stored else np.zeros(register_count(self.p), np.uint8)
        results, begin = [], 0
        for end in closing_packets(packets["tuples"], packets["last"], held, self.size, self.close_rule):
            own = slice(bounds[begin], bounds[end + 1])
            self._fold(registers, bucket[own], rank[own])
            size += int(packets["length"][begin:end + 1].sum())
            windows += 1
            results.append((opened, windows, size, *register_words(registers, self.words)))
            registers[:] = 0
            held = size = 0
            begin = end + 1
        own = slice(bounds[begin], bounds[-1])
        self._fold(registers, bucket[own], rank[own])
        held += int(packets["tuples"][begin:].sum())
        size += int(packets["length"][begin:].sum())
        self.progress.update((opened, windows, held, size))
        self.registers.update((pack(registers),))
        return results

    @staticmethod
    def _fold(registers: np.ndarray, bucket: np.ndarray, rank: np.ndarray) -> None:
        known = bucket >= 0
        np.maximum.at(registers, bucket[known], rank[known].astype(np.uint8))

    def close(self) -> None:
        pass


@dataclass(frozen=True)
class KeyedWindows:
    """Distinct keys per window of ``size`` keys over packets ``(seq, length, payload, closed, by...)``.

    ``close`` is a rule of ``PacketWindows``: ``'at_least'``, ``'exact'`` or ``'last'`` (needs a ``last`` column). ``by`` names
    the session columns; empty, everything is one session. ``seq`` grows from batch to batch within a session, and is
    sorted inside a batch. A window open when its session closes gives no result. NULL flags count as false, NULL payloads
    and keys as none, and empty packets only for their ``closed``. ``idle`` (such as ``'2 hours'``) drops silent sessions.

    ``folder`` receives ``result``: ``by..., opened, window_id, offset, length, estimate`` for each closed window, where ``opened``
    is the ``seq`` of the session's first packet and ``offset`` the bytes of the window.
    """

    folder: str
    size: int = 0
    close: str = "at_least"
    by: tuple[str, ...] = ("session_id",)
    p: int = 16
    hash: str = "murmur3_64_h1"
    idle: str | None = None

    def __post_init__(self) -> None:
        check_p(self.p)
        check_groups(self.by)
        get_hash(self.hash)
        if self.close not in CLOSE_RULES:
            raise ValueError(f"close must be one of {', '.join(CLOSE_RULES)}, got {self.close!r}")
        if self.close != "last" and self.size < 1:
            raise ValueError(f"size must be positive, got {self.size}")

    def _ranked_keys(self, packets: DataFrame) -> DataFrame:
        """One row for each key of a packet, with its bucket and rank; a packet without keys is one row with bucket -1."""
        flag = {name: F.coalesce(F.col(name), F.lit(False)) if name in packets.columns else F.lit(False) for name in ("last", "closed")}
        told = packets.where(F.expr(is_not_empty("length")) | flag["closed"])
        rows = told.select(
            *(_key_text(c, packets.schema[c].dataType).alias(f"__by{i}") for i, c in enumerate(self.by)), F.col("seq").cast("bigint").alias("seq"),
            F.coalesce(F.col("length").cast("bigint"), F.lit(0)).alias("length"),
            F.coalesce(F.expr(tuples_in_packet("length")), F.lit(0)).alias("tuples"),
            flag["last"].alias("last"), flag["closed"].alias("closed"),
            F.explode_outer(F.col("payload").cast("array<bigint>")).alias("__k"),
        )
        return ranked_keys(rows, "__k", self.p, self.hash)

    def results(self, packets: DataFrame) -> DataFrame:
        """The streaming DataFrame of closed windows."""
        spec = get_hash(self.hash)
        words = words_for(spec.width)
        names = [f"__by{i}" for i in range(len(self.by))] or ["__all"]
        rows = self._ranked_keys(packets)
        if not self.by:
            rows = rows.withColumn("__all", F.lit(""))
        numbers = ["opened", "window_id", "offset", "nonempty", *(f"word{i}" for i in range(words))]
        schema = T.StructType(
            [T.StructField(n, T.StringType()) for n in names] + [T.StructField(n, T.LongType()) for n in numbers])
        idle = None if self.idle is None else int(pd.Timedelta(self.idle).total_seconds() * 1000)
        closed = rows.groupBy(*names).transformWithStateInPandas(
            _Session(names, self.size, self.close, self.p, words, idle), schema, "append",
            "none" if idle is None else "processingTime",
        )
        sums = closed.withColumn("length", F.lit(RESULT_BYTES).cast("bigint"))
        done = finish(sums, self.p, words, [*names, "opened", "window_id", "offset", "length"])
        return done.select(
            *(_key_value(f"__by{i}", packets.schema[c].dataType).alias(c) for i, c in enumerate(self.by)),
            "opened", "window_id", "offset", "length", "estimate")

    def start(self, packets: DataFrame, available_now: bool = True) -> StreamingQuery:
        """Run with the RocksDB store; a replayed batch replaces its own results."""
        conf = packets.sparkSession.conf
        wanted = {_PROVIDER: STORE} | ({_EMPTY_BATCHES: "false"} if self.idle is not None and available_now else {})
        before = {name: conf.get(name, None) for name in wanted}
        for name, value in wanted.items():
            conf.set(name, value)
        try:  # a query keeps the settings it starts with
            writer = self.results(packets).writeStream.outputMode("append").foreachBatch(
                lambda batch, batch_id: write_batch(batch, f"{self.folder}/result", batch_id))
            return start(writer, f"{self.folder}/checkpoint", available_now)
        finally:
            for name, value in before.items():
                conf.unset(name) if value is None else conf.set(name, value)

    def read(self, spark: SparkSession) -> DataFrame:
        """Every window closed so far."""
        return spark.read.parquet(f"{self.folder}/result").drop("batch_id")
