"""Sketches over streams: running totals and event-time windows.

The register operators themselves work on streams unchanged; the functions here add the sinks and the windows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..functions.hashes import HashFunction, get_hash
from ..operators.estimate import estimate_registers, finish, register_sums, words_for
from ..operators.registers import build_registers, merge_registers, ranks, smallest_hashes
from ..sources.sinks import write_batch


def start(writer: DataStreamWriter, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _keep(batch: DataFrame, batch_id: int, folder: str, by: Sequence[str], compact: int) -> None:
    """Store the registers a micro-batch has changed; every ``compact`` batches fold all so far into one table.

    What is folded is deleted a round later, when no replay can ask for it.
    """
    write_batch(batch, f"{folder}/registers", batch_id)
    if compact and (batch_id + 1) % compact == 0:
        spark = batch.sparkSession
        read_kept_registers(spark, folder, by).write.mode("overwrite").parquet(f"{folder}/folded/upto={batch_id}")
        for old in range(max(0, batch_id + 1 - 2 * compact), batch_id + 1 - compact):
            _delete(spark, f"{folder}/registers/batch_id={old}")
        _delete(spark, f"{folder}/folded/upto={batch_id - 2 * compact}")


def _path(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path, files = _path(spark, path)
    files.delete(jvm_path, True)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers in the folder names ``name=number`` below a path whose contents are complete."""
    jvm_path, files = _path(spark, path)
    if not files.exists(jvm_path):
        return []
    found = [s.getPath() for s in files.listStatus(jvm_path) if s.isDirectory()]
    done = [f.getName() for f in found if files.exists(_path(spark, f"{f}/_SUCCESS")[0])]
    return sorted(int(name.split("=")[1]) for name in done)


def keep_registers(
    stream: DataFrame, folder: str, key: str, p: int = 14, hash: str | HashFunction = "murmur3_32",
    by: Sequence[str] = (), available_now: bool = True, compact: int = 100,
) -> StreamingQuery:
    """Maintain registers over a stream; each micro-batch writes only the registers that changed.

    State is at most ``2**p`` rows per group.  Read the current registers with ``read_kept_registers``; at most
    ``2 * compact`` batches are kept apart.
    """
    registers = build_registers(stream, key, p, hash, by)
    writer = registers.writeStream.outputMode("update").foreachBatch(
        lambda batch, batch_id: _keep(batch, batch_id, folder, by, compact)
    )
    return start(writer, f"{folder}/checkpoint", available_now)


def read_kept_registers(spark: SparkSession, folder: str, by: Sequence[str] = ()) -> DataFrame:
    """Registers as of the last finished micro-batch."""
    folded = _numbers(spark, f"{folder}/folded")
    last = folded[-1] if folded else -1
    later = [n for n in _numbers(spark, f"{folder}/registers") if n > last]
    parts = [spark.read.parquet(*[f"{folder}/registers/batch_id={n}" for n in later])] if later else []
    parts += [spark.read.parquet(f"{folder}/folded/upto={last}")] if folded else []
    return merge_registers(*parts, by=by)


def keep_estimates(
    stream: DataFrame, folder: str, key: str, p: int = 14, hash: str | HashFunction = "murmur3_32",
    by: Sequence[str] = (), available_now: bool = True, compact: int = 100,
) -> StreamingQuery:
    """After every micro-batch, append the estimates over everything seen so far of the groups it has changed:
    ``(batch_id, by..., estimate)``."""
    width = get_hash(hash).width
    registers = build_registers(stream, key, p, hash, by)

    def emit(batch: DataFrame, batch_id: int) -> None:
        _keep(batch, batch_id, folder, by, compact)
        kept = read_kept_registers(batch.sparkSession, folder, by)
        if by:
            changed = batch.sparkSession.read.parquet(f"{folder}/registers/batch_id={batch_id}").select(
                F.struct(*by).alias("__key")).distinct()
            kept = kept.withColumn("__key", F.struct(*by)).join(changed, "__key", "left_semi").drop("__key")
        write_batch(estimate_registers(kept, p, width, by).select(*by, "estimate"), f"{folder}/estimates", batch_id)

    writer = registers.writeStream.outputMode("update").foreachBatch(emit)
    return start(writer, f"{folder}/checkpoint", available_now)


def _window_registers(df: DataFrame, key: str, window: Column, p: int, hash: str | HashFunction, by: Sequence[str]) -> DataFrame:
    group = ["window", *by]
    windowed = df.select(*by, key, window.alias("window"))
    return ranks(smallest_hashes(windowed, key, p, hash, group), p, hash, group)


def event_time_estimates(
    df: DataFrame, key: str, time: str, length: str, slide: str | None = None, delay: str = "0 seconds", p: int = 14,
    hash: str | HashFunction = "murmur3_32", by: Sequence[str] = (),
) -> DataFrame:
    """Estimate per event-time window ``(window_start, window_end, by..., estimate, ...)``, batch or streaming.

    On a stream use append mode: a window comes out once the watermark (latest time minus ``delay``) has passed it, and
    rows later than that are dropped.
    """
    words = words_for(get_hash(hash).width)
    timed = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    group = ["window", *by]
    if slide and not pd.Timedelta(length) % pd.Timedelta(slide):
        # Every window is made of whole panes of one slide: rows are hashed once, and registers are spread, not rows.
        panes = _window_registers(timed, key, F.window(time, slide), p, hash, by)
        spread = panes.withColumn("window", F.window(F.window_time("window"), length, slide))
        registers = merge_registers(spread, by=group)
    else:
        registers = _window_registers(timed, key, F.window(time, length, slide), p, hash, by)
    sums = registers.groupBy(*group).agg(*register_sums(words))
    return finish(sums, p, words, group).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by,
        "estimate", "zeros", "harmonic", "raw",
    )


def keep_event_time_estimates(estimates: DataFrame, folder: str, available_now: bool = True) -> StreamingQuery:
    """Append finished windows of ``event_time_estimates`` to a Parquet table."""
    writer = estimates.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/windows")
    return start(writer, f"{folder}/checkpoint", available_now)
