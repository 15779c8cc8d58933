"""Merging live streams in the order that a third one gives, with state that watermarks bound.

An item carries ``turn``, its 0-based place in its own stream, and so does an entry of the origin stream among those that name
the item's source. Both sides meet by source and turn, whichever comes first. The turn is also the event time of the merge: each
side drops what lies more than ``slack`` turns behind the largest turn that all streams have reached, so state holds only
what is waiting for a slower stream. One source's turns say nothing about the other's.

What waits can be most of a stream. A join of the streams keeps two entries for every row in its state; here rows are packed by
source and block of turns before they are shuffled, a block's state is one packed table for each side, and a batch reads and
writes only the blocks that it brings rows for or that the watermark reaches.

A fair merge needs no state: items sorted by ``(turn, source)`` alternate, see ``operators.routing.merge_fair``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.sinks import write_batch
from .registers import start

# Ship the functions used inside tasks by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TIME = "__time"
_TASKS = "spark.sql.shuffle.partitions"
#: Turns of a block: 2**12.
BLOCK_BITS = 12
#: A block is one row to the shuffle and the state, so tasks with state are fewer than those of a shuffle of rows.
TASKS_SHARE = 4
#: A task packs about so many rows or bytes at once, and gives back so many rows in one piece.
_ROWS, _BYTES = 1 << 18, 1 << 25
Batches = Iterator[pa.RecordBatch]


def _timed(stream: DataFrame, turn: str, slack: int) -> DataFrame:
    """The turn as a time in seconds, with a watermark more than ``slack`` turns behind; what lies on it counts as late, and it
    begins at 0."""
    return stream.withColumn(_TIME, F.timestamp_seconds(F.col(turn) + 1)).withWatermark(_TIME, f"{slack + 1} seconds")


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(rows).read_all()


def _turns(table: pa.Table | None) -> np.ndarray:
    return np.empty(0, np.int64) if table is None else table["__turn"].to_numpy()


def _blocks(rows: pa.Table, named: bool, bits: int) -> pa.RecordBatch:
    source, turn = rows["__source"].to_numpy(), rows["__turn"].to_numpy()
    order = np.lexsort((turn, source))
    rows, source, turn = rows.drop_columns(["__source"]).take(pa.array(order)), source[order], turn[order]
    block = turn >> bits
    begin = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (source[1:] != source[:-1])))
    end = np.append(begin[1:], len(turn))
    packed = [_packed(rows.slice(a, b - a)) for a, b in zip(begin, end)]
    return pa.RecordBatch.from_arrays(
        [pa.array(source[begin], pa.int32()), pa.array(block[begin]), pa.array(np.full(len(begin), named)),
         pa.array(turn[end - 1]), pa.array(packed, pa.binary())], ["__source", "__block", "__named", "__last", "__rows"])


def _packing(named: bool, bits: int) -> Callable[[Batches], Batches]:
    """Rows with a source and a turn as one packed table for each block of them, with the block's largest turn."""

    def work(batches: Batches) -> Batches:
        waiting, rows, size = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                waiting, rows, size = [*waiting, batch], rows + batch.num_rows, size + batch.nbytes
            if rows >= _ROWS or size >= _BYTES:
                yield _blocks(pa.Table.from_batches(waiting), named, bits)
                waiting, rows, size = [], 0, 0
        if waiting:
            yield _blocks(pa.Table.from_batches(waiting), named, bits)

    return work


def _pairs(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Places of all rows of both sides that have the same turn, in pieces."""
    order = np.argsort(right, kind="stable")
    low, high = (np.searchsorted(right[order], left, side) for side in ("left", "right"))
    n = high - low
    upto, done = np.cumsum(n), 0
    while done < len(left):
        before = upto[done] - n[done]
        end = max(done + 1, int(np.searchsorted(upto, before + _ROWS, "right")))
        here = n[done:end]
        nth = np.arange(here.sum()) - np.repeat(upto[done:end] - here - before, here)
        if len(nth):
            yield pa.array(np.repeat(np.arange(done, end), here)), pa.array(order[np.repeat(low[done:end], here) + nth])
        done = end


def _after(table: pa.Table, reached: int) -> pa.Table:
    """The rows whose time a watermark has not reached."""
    ahead = _turns(table) + 1 > reached
    return table if ahead.all() else table.filter(pa.array(ahead))


def _concat(*tables: pa.Table | None) -> pa.Table | None:
    tables = [t for t in tables if t is not None]
    return pa.concat_tables(tables).combine_chunks() if tables else None


def _meeting(bits: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def meet(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """What meets in one block in this batch; what the watermark has not reached stays, met or not."""
        *held, late = state.get if state.exists else (None, None, 0)
        # pandas is what the API hands over: a packed table in each row. Some rows of a block may be late where others aren't.
        come = [(named, _after(_unpacked(rows), late)) for frame in frames for named, rows in zip(frame["__named"], frame["__rows"])]
        new_named, new_items = (_concat(*[rows for named, rows in come if named == side]) for side in (True, False))
        old_named, old_items = (None if rows is None else _unpacked(bytes(rows)) for rows in held)
        named, items = _concat(old_named, new_named), _concat(old_items, new_items)
        for left, right in ((new_named, items), (old_named, new_items)):
            for a, b in _pairs(_turns(left), _turns(right)):
                met, other = (t.drop_columns(["__turn"]).take(places).columns for t, places in ((left, a), (right, b)))
                columns = [*met, pa.array(np.full(len(a), key[0]), pa.int32()), *other]
                yield pd.DataFrame({"rows": [_packed(pa.table(columns, [str(i) for i in range(len(columns))]))]})
        # Times are whole seconds, one more than the turn.
        reached, block = int(state.getCurrentWatermarkMs()) // 1000, int(key[1])
        if reached < (block + 1) << bits:
            kept = [None if t is None else _after(t, reached) for t in (named, items)]
            state.update((*[_packed(t) if t is not None and len(t) else None for t in kept], reached))
            # Called again when the watermark goes on inside the block.
            state.setTimeoutTimestamp(max(reached * 1000, ((block << bits) + 1) * 1000 - 1))
        elif state.exists:
            state.remove()

    return meet


def _unpacking(names: Sequence[str]) -> Callable[[Batches], Batches]:
    def work(batches: Batches) -> Batches:
        for batch in batches:
            for rows in batch.column(0):
                for part in _unpacked(rows.as_py()).to_batches():
                    yield pa.RecordBatch.from_arrays(part.columns, list(names))

    return work


def _joined(named: Sequence[DataFrame], items: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """The merge where not all inputs are streams."""
    parts = [a.join(b, ["__source", "__turn"]).select("position", F.col("__source").alias("source"), *columns)
             for a, b in zip(named, items)]
    return parts[0].unionByName(parts[1])


def merge_streams_by_origin(
    origin: DataFrame, first: DataFrame, second: DataFrame, slack: int = 100_000, bits: int = BLOCK_BITS
) -> DataFrame:
    """The items that an origin stream ``(position, source, turn)`` names, with ``position`` and ``source`` (0: first, 1: second).

    ``first`` and ``second`` have the same columns, among them ``turn``. In each stream a turn may come at most ``slack`` turns after
    a larger one has, in an earlier batch; what comes later is dropped. Rows with a NULL turn or another source meet nothing.
    Append mode; the result can go on to any sink. A task holds ``2**bits`` turns of both sides at once: fewer bits suit wide rows.

    An item and an entry that both come too late, in one batch, may meet if they are the first rows of their block.
    """
    columns = [c for c in first.columns if c != "turn"]
    turn = F.col("turn").cast("bigint").alias("__turn")
    named, items = [], []
    for source, stream in enumerate((first, second)):
        entries = origin.where(F.col("source") == source)
        for found, rows, own in ((named, entries, ["position"]), (items, stream, columns)):
            found.append(rows.where("turn IS NOT NULL").select(F.lit(source).alias("__source"), turn, *own))
    if not all(stream.isStreaming for stream in (origin, first, second)):
        return _joined(named, items, columns)
    # Each column has one type in both streams, as in a union of them.
    kinds = {c.name: c.dataType for side in (named[0], items[0].unionByName(items[1])) for c in side.schema} | {"source": T.IntegerType()}
    items = [rows.select("__source", "__turn", *[F.col(c).cast(kinds[c]).alias(c) for c in columns]) for rows in items]
    # Four streams of blocks, each with the watermark of its own largest turn; a block is late when its largest turn is.
    schema = "__source INT, __block BIGINT, __named BOOLEAN, __last BIGINT, __rows BINARY"
    blocks = None
    for side, streams in ((True, named), (False, items)):
        for rows in streams:
            packed = _timed(rows.mapInArrow(_packing(side, bits), schema), "__last", slack)
            blocks = packed if blocks is None else blocks.union(packed)
    met = blocks.groupBy("__source", "__block").applyInPandasWithState(
        _meeting(bits), "rows BINARY", "named BINARY, items BINARY, reached BIGINT", "append", GroupStateTimeout.EventTimeTimeout)
    names = ["position", "source", *columns]
    return met.mapInArrow(_unpacking(names), T.StructType([T.StructField(c, kinds[c]) for c in names]))


def keep_merged(merged: DataFrame, folder: str, available_now: bool = True) -> StreamingQuery:
    """Append what each micro-batch merges to ``folder/merged``; a replayed batch replaces its own rows."""
    writer = merged.writeStream.outputMode("append").foreachBatch(
        lambda batch, batch_id: write_batch(batch, f"{folder}/merged", batch_id))
    conf = merged.sparkSession.conf
    tasks = conf.get(_TASKS)
    conf.set(_TASKS, max(1, int(tasks) // TASKS_SHARE))
    try:  # a query keeps the settings it starts with
        return start(writer, f"{folder}/checkpoint", available_now)
    finally:
        conf.set(_TASKS, tasks)
