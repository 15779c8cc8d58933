"""Count-based windows that close at the first packet reaching their size.

Each close depends on the one before, but only through one number: the keys already held when a packet arrives.  So a
block of packets is summarised, without knowing that number, by what would follow from a first close at each of its
early packets.  Summaries of neighbouring blocks are combined, ``2**FAN_BITS`` at a time, until few are left; those are
walked, and the numbers go back down level by level.  With the number known at every block's start the blocks are cut
into windows independently.  No task sees more than one block of packets or ``2**FAN_BITS`` summaries, and a summary
lists no packet beyond the first ``size`` keys it covers.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import BLOCK_BITS
from .windows import packet_tuples

# Ship the functions used inside tasks by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT_ROWS = 10000
FAN_BITS = 6
_SQL_TYPES = {
    pa.string(): "STRING", pa.int64(): "BIGINT", pa.bool_(): "BOOLEAN", pa.list_(pa.int64()): "ARRAY<BIGINT>",
}


def closing_packets(tuples: np.ndarray, size: int, held: int) -> np.ndarray:
    """Positions of the packets that bring the keys since the last close to ``size``; one binary search per window."""
    totals = np.cumsum(tuples) + held
    closing, base = [], 0
    while (at := int(np.searchsorted(totals, base + size))) < len(totals):
        closing.append(at)
        base = int(totals[at])
    return np.asarray(closing, dtype=np.int64)


def summarise(tuples: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """What a block does for any number of keys held at its start.

    Returns ``(reach, closes, left, total)``: if the first close is at packet j (the first with ``held + reach[j] >=
    size``), the block closes ``closes[j]`` windows and leaves ``left[j]`` keys held; without a close it adds ``total``.
    Only packets that can be a first close are listed.
    """
    reach = np.cumsum(tuples)
    n, total = len(reach), int(reach[-1])
    follow = np.append(np.searchsorted(reach, reach + size), n)
    count, final = np.append(np.ones(n, np.int64), 0), np.arange(n + 1)
    # Pointer doubling: after k rounds every packet knows what its next 2**k closes lead to.
    while (follow < n).any():
        final = np.where(follow < n, final[follow], final)
        count = count + count[follow]
        follow = follow[follow]
    first = min(n, int(np.searchsorted(reach, size)) + 1)
    return reach[:first], count[:first], (total - reach[final[:n]])[:first], total


def _runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str], values: Sequence[str]):
    """Consecutive rows with equal keys in a sorted partition: ``(key, [value array...])``, one run in memory at a time."""
    current, parts = None, []
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        labels = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        arrays = [batch.column(batch.schema.get_field_index(v)).to_numpy(zero_copy_only=False) for v in values]
        change = np.zeros(rows, bool)
        for label in labels:
            change[1:] |= pc.not_equal(label.slice(1), label.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
        edges = [0, *np.flatnonzero(change).tolist(), rows]
        for low, high in zip(edges, edges[1:]):
            key = tuple(label[low].as_py() for label in labels)
            if key != current and parts:
                yield current, [np.concatenate(p) for p in zip(*parts)]
                parts = []
            current = key
            parts.append([a[low:high] for a in arrays])
    if parts:
        yield current, [np.concatenate(p) for p in zip(*parts)]


def _batches(tables: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pack many small column sets into record batches."""
    held, rows = [], 0
    for table in tables:
        held.append(pa.RecordBatch.from_arrays([pa.array(table[f.name], f.type) for f in schema], schema=schema))
        rows += held[-1].num_rows
        if rows >= OUTPUT_ROWS or len(held) >= OUTPUT_ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _summaries(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[dict]:
    for (group, block), (tuples,) in _runs(batches, ["__group", "__block"], ["tuples"]):
        reach, closes, left, total = summarise(tuples, size)
        yield {
            "__group": [group], "__block": [block], "reach": [reach], "closes": [closes], "left": [left], "total": [total]
        }


def combine(first: tuple, second: tuple, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Summary of a stretch of packets from those of its two halves."""
    reach, closes, left, total = first
    reach2, closes2, left2, total2 = second
    # After a first close in the first half, the second half goes on with what that leaves.
    at = np.searchsorted(reach2, size - left)
    again = at < len(reach2)
    counted, kept = closes.copy(), left + total2
    counted[again] += closes2[at[again]]
    kept[again] = left2[at[again]]
    if total < size:
        # The first close may also come in the second half, as far as it can be reached.
        far = min(len(reach2), int(np.searchsorted(reach2, size - total)) + 1)
        reach, counted, kept = (
            np.concatenate([reach, total + reach2[:far]]), np.concatenate([counted, closes2[:far]]),
            np.concatenate([kept, left2[:far]]),
        )
    return reach, counted, kept, total + total2


SUMMARY = ["reach", "closes", "left", "total"]


def _combined(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[dict]:
    """Summaries of neighbouring blocks, one for each block of the next level."""
    for (group, block), columns in _runs(batches, ["__group", "__above"], SUMMARY):
        whole = None
        for part in zip(*columns):
            part = (*map(np.asarray, part[:3]), int(part[3]))
            whole = part if whole is None else combine(whole, part, size)
        yield {"__group": [group], "__block": [block], **{name: [value] for name, value in zip(SUMMARY, whole)}}


def _walk(blocks: Sequence, held: int, closed: int, size: int) -> tuple[list[int], list[int], int]:
    """Keys held and windows closed before each of a series of blocks, and the windows closed in the end."""
    before: tuple[list[int], list[int]] = ([], [])
    for reach, closes, left, total in blocks:
        before[0].append(held)
        before[1].append(closed)
        at = int(np.searchsorted(reach, size - held))
        if at < len(reach):
            closed, held = closed + int(closes[at]), int(left[at])
        else:
            held += int(total)
    return *before, closed


def _entries(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[dict]:
    """Of the blocks of the last level: keys held and windows closed before each, and the windows closed in the group."""
    for (group,), (blocks, *summaries) in _runs(batches, ["__group"], ["__block", *SUMMARY]):
        held, earlier, closed = _walk(list(zip(*summaries)), 0, 0, size)
        yield {"__group": [group] * len(blocks), "__block": blocks, "__held": held, "__earlier": earlier,
               "__closed": [closed] * len(blocks)}


def _descended(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[dict]:
    """The same for the blocks of a level, from what is known of the blocks above."""
    columns = ["__block", *SUMMARY, "__held", "__earlier", "__closed"]
    for (group, _), (blocks, *summaries, above_held, above_earlier, closed) in _runs(batches, ["__group", "__above"], columns):
        held, earlier, _ = _walk(list(zip(*summaries)), int(above_held[0]), int(above_earlier[0]), size)
        yield {"__group": [group] * len(blocks), "__block": blocks, "__held": held, "__earlier": earlier, "__closed": closed}


def _cuts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[dict]:
    columns = ["seq", "tuples", "__held", "__earlier", "__closed"]
    for (group, _), (seq, tuples, held, earlier, closed) in _runs(batches, ["__group", "__block"], columns):
        if (seq[1:] == seq[:-1]).any():
            raise ValueError("seq must be unique within a group")
        closing = closing_packets(tuples, size, int(held[0]))
        position = np.arange(len(seq))
        window = np.searchsorted(closing, position) + earlier + 1
        closes = np.zeros(len(seq), bool)
        closes[closing] = True
        yield {
            "__group": [group] * len(seq), "seq": seq, "window_id": window, "closes": closes,
            "window_closed": window <= closed,
        }


def _over_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn, size: int, fields: list) -> DataFrame:
    """Run ``fn`` over partitions that hold whole key groups in order."""
    arrow = pa.schema(fields)
    ddl = ", ".join(f"{f.name} {_SQL_TYPES[f.type]}" for f in arrow)
    placed = df.repartition(*keys).sortWithinPartitions(*order)
    return placed.mapInArrow(lambda batches: _batches(fn(batches, size), arrow), ddl)


def reaching_windows(packets: DataFrame, size: int, by: Sequence[str] = (), bits: int = BLOCK_BITS) -> DataFrame:
    """Like ``count_windows``, with windows that close at the first packet reaching ``size`` keys.

    ``seq`` must be non-NULL and unique within a group, else the query fails.
    """
    if size < 1:
        raise ValueError(f"size must be positive, got {size}")
    used = packet_tuples(packets)
    # A text key stands for the group columns, NULLs included.
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    seq = "coalesce(CAST(seq AS BIGINT), CAST(raise_error('seq must not be NULL') AS BIGINT))"
    narrow = used.select(group.alias("__group"), F.expr(seq).alias("seq"), "tuples").withColumn(
        "__block", F.expr(f"shiftright(seq, {bits})"))
    block, whole, list_type = ["__group", "__block"], ["__group"], pa.list_(pa.int64())
    label, number = ("__group", pa.string()), pa.int64()
    summary = [("reach", list_type), ("closes", list_type), ("left", list_type), ("total", number)]
    state = [("__held", number), ("__earlier", number), ("__closed", number)]
    blocks = _over_sorted(narrow, block, [*block, "seq"], _summaries, size, [label, ("__block", number), *summary])

    # Levels depend on the largest sequence number only: above the last one no group has more than a few blocks.
    last = narrow.agg(F.max("__block")).first()[0] or 0
    levels = [blocks]
    while last >> FAN_BITS:
        last >>= FAN_BITS
        above = levels[-1].withColumn("__above", F.expr(f"shiftright(__block, {FAN_BITS})"))
        levels.append(_over_sorted(
            above, ["__group", "__above"], ["__group", "__above", "__block"], _combined, size,
            [label, ("__block", number), *summary],
        ))
    entries = _over_sorted(levels.pop(), whole, block, _entries, size, [label, ("__block", number), *state])
    for level in reversed(levels):
        below = level.withColumn("__above", F.expr(f"shiftright(__block, {FAN_BITS})"))
        known = entries.withColumnRenamed("__block", "__above")
        entries = _over_sorted(
            below.join(known, ["__group", "__above"]), ["__group", "__above"], ["__group", "__above", "__block"], _descended,
            size, [label, ("__block", number), *state],
        )
    assigned = _over_sorted(
        narrow.join(entries, block), block, [*block, "seq"], _cuts, size,
        [label, ("seq", number), ("window_id", number), ("closes", pa.bool_()), ("window_closed", pa.bool_())],
    )
    return used.withColumn("__group", group).join(assigned, ["__group", "seq"]).select(
        *used.columns, "window_id", "closes", "window_closed"
    )
