"""Counters and rates of a running stream: keys read and registers written, batch by batch, while it runs.

The counts are observed metrics, computed inside the batch's own job; a listener receives them when a batch ends, so they
can be read from the driver at any time without touching the data. A replayed batch replaces its entry.
"""

from __future__ import annotations

import threading
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.bits import KEY_BYTES
from ..functions.hashes import HashFunction
from ..operators.registers import ranks, smallest_hashes
from ..sources.sinks import write_batch
from .registers import start

CONSUMED, PRODUCED = "tally_consumed", "tally_produced"


@dataclass(frozen=True)
class BatchCounters:
    """One batch: keys read (NULLs apart), registers it wrote, input rows, its time and its rates."""

    batch_id: int
    keys: int
    nulls: int
    registers: int
    input_rows: int
    seconds: float
    rows_per_s: float
    mb_per_s: float


class StreamCounters(StreamingQueryListener):
    """Counters of the streams built with ``counted_registers``; one listener may watch several queries.

    Attach it before the query starts. ``batches``, ``totals`` and ``table`` may be read from any thread during the run; a
    query is named by its ``id``, which stays the same across restarts. A batch without input has no entry.
    """

    def __init__(self) -> None:
        self._lock = threading.Condition()
        self._batches: dict[str, dict[int, BatchCounters]] = {}
        self._ended: set[str] = set()

    def attach(self, spark: SparkSession) -> StreamCounters:
        spark.streams.addListener(self)
        return self

    def detach(self, spark: SparkSession) -> None:
        spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = progress.observedMetrics
        if CONSUMED not in seen or not progress.numInputRows:
            return
        consumed, produced = seen[CONSUMED], seen.get(PRODUCED)
        seconds = max(progress.durationMs.get("triggerExecution", 0), 1) / 1000
        entry = BatchCounters(
            progress.batchId, consumed["keys"], consumed["rows"] - consumed["keys"],
            produced["registers"] if produced is not None else 0, progress.numInputRows, seconds,
            progress.numInputRows / seconds, KEY_BYTES * consumed["keys"] / seconds / 1e6,
        )
        with self._lock:
            self._batches.setdefault(str(progress.id), {})[entry.batch_id] = entry
            self._lock.notify_all()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._ended.add(str(event.runId))
            self._lock.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> bool:
        """Wait until everything the ended run of a query has reported is here."""
        with self._lock:
            return self._lock.wait_for(lambda: str(query.runId) in self._ended, seconds)

    def wait_for_batch(self, query: StreamingQuery, batch_id: int, seconds: float = 60) -> bool:
        """Wait until a batch of a running query has been counted."""
        with self._lock:
            return self._lock.wait_for(lambda: batch_id in self._batches.get(str(query.id), {}), seconds)

    def batches(self, query_id: str) -> list[BatchCounters]:
        with self._lock:
            return sorted(self._batches.get(str(query_id), {}).values(), key=lambda b: b.batch_id)

    def totals(self, query_id: str) -> tuple[int, int]:
        """Keys read and registers written by all batches so far."""
        found = self.batches(query_id)
        return sum(b.keys for b in found), sum(b.registers for b in found)

    def table(self, spark: SparkSession, query_id: str) -> DataFrame:
        """The entries as a DataFrame, one row per batch."""
        rows = [tuple(asdict(b).values()) for b in self.batches(query_id)]
        return spark.createDataFrame(
            rows, "batch_id BIGINT, keys BIGINT, nulls BIGINT, registers BIGINT, input_rows BIGINT, seconds DOUBLE,"
            " rows_per_s DOUBLE, mb_per_s DOUBLE")


def counted_registers(
    stream: DataFrame, key: str, p: int = 14, hash: str | HashFunction = "murmur3_32", by: Sequence[str] = (),
) -> DataFrame:
    """Registers of a stream (or table) that count what goes in and out; a batch counts the registers its keys fall into."""
    watched = stream.observe(CONSUMED, F.count(F.lit(1)).alias("rows"), F.count(F.col(key)).alias("keys"))
    registers = ranks(smallest_hashes(watched, key, p, hash, by), p, hash, by)
    return registers.observe(PRODUCED, F.count(F.when(F.col("rank") > 0, 1)).alias("registers"))


def keep_counted_registers(
    stream: DataFrame, folder: str, key: str, p: int = 14, hash: str | HashFunction = "murmur3_32",
    by: Sequence[str] = (), available_now: bool = True,
) -> StreamingQuery:
    """Write the registers each batch has changed, as ``registers.keep_registers`` does, and count them."""
    registers = counted_registers(stream, key, p, hash, by)
    writer = registers.writeStream.outputMode("update").foreachBatch(
        lambda batch, batch_id: write_batch(batch, f"{folder}/registers", batch_id))
    return start(writer, f"{folder}/checkpoint", available_now)
