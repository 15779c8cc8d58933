"""Running sums and maxima along columns of any sortable type, in two passes over range partitions.

The rows are dealt by range of group and order columns and scanned where they land; each partition stores its rows with the
running value inside it, and its first and last row say what it adds up to. What the partitions add up to is a table of
two rows for each, however many rows they hold; accumulated on the driver, it gives one offset for each partition, and the
second pass adds that to the rows of the group that was open when the partition began. Rows are shuffled once, and joined
with nothing but the offsets.

``running.running`` needs integer order values that don't repeat; here times, texts and several columns do, and rows that
are equal in all of them are peers: they come to one partition and get one value.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import new_folder

KINDS = {"sum": (np.add, np.int64(0)), "max": (np.maximum, np.iinfo(np.int64).min)}
#: Bits of the edge column: first and last row of a partition.
_FIRST, _LAST = 1, 2


def _fresh(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row differs from the one before in any column; two NULLs are equal, and so are two NaNs. The first row
    counts as different."""
    size = len(columns[0])
    out = np.zeros(size, bool)
    out[:1] = True
    for column in columns:
        # Dictionary codes make every sortable type one comparison.
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= codes[1:] != codes[:-1]
    return out


class _Scan:
    """Running values of one partition, batch by batch; peers that a batch may have cut wait for the next."""

    def __init__(self, kinds: list[str], n_by: int, n_order: int, inclusive: bool) -> None:
        self.kinds, self.n_by, self.n_keys, self.inclusive = kinds, n_by, n_by + n_order, inclusive
        self.part = TaskContext.get().partitionId()
        self.carry = [KINDS[kind][1] for kind in kinds]
        self.open, self.begun, self.last_key = True, False, None

    def batch(self, rows: pa.Table) -> pa.Table:
        """``rows`` hold whole runs of peers: keys first, then the values, then what is passed along."""
        rows = rows.combine_chunks()
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns]
        keys, values = columns[:self.n_keys], columns[self.n_keys:self.n_keys + len(self.kinds)]
        size = rows.num_rows
        peers = _fresh(keys)
        group = _fresh(keys[:self.n_by]) if self.n_by else np.arange(size) == 0
        first_key = tuple(pa.array([c[0].as_py()], c.type) for c in keys[:self.n_by])
        goes_on = self.begun and all(a.equals(b) or _both_nan(a, b) for a, b in zip(first_key, self.last_key))
        if goes_on:
            group[0] = False
        run = np.flatnonzero(peers)
        number = np.cumsum(peers) - 1
        # A run of peers is one step; groups restart.
        starts = np.flatnonzero(group[run])
        segments = np.unique(np.append(0, starts))
        out = []
        for place, kind in enumerate(self.kinds):
            combine, zero = KINDS[kind]
            step = combine.reduceat(values[place].to_numpy(), run)
            upto = np.empty_like(step)
            for a, b in zip(segments, np.append(segments[1:], len(step))):
                upto[a:b] = combine.accumulate(step[a:b])
            if goes_on:
                end = starts[0] if len(starts) else len(step)
                upto[:end] = combine(upto[:end], self.carry[place])
            before = np.empty_like(upto)
            before[1:], before[0] = upto[:-1], self.carry[place] if goes_on else zero
            before[starts] = zero
            out.append((upto if self.inclusive else before)[number])
            self.carry[place] = upto[-1]
        in_first = np.zeros(size, bool)
        if self.open:
            end = run[starts[1 if not self.begun else 0]] if len(starts) > (0 if self.begun else 1) else size
            in_first[:end] = True
            self.open = end == size
        edge = np.zeros(size, np.int8)
        edge[0] = 0 if self.begun else _FIRST
        self.begun = True
        self.last_key = tuple(pa.array([c[size - 1].as_py()], c.type) for c in keys[:self.n_by])
        return pa.Table.from_arrays(
            [*columns, *map(pa.array, out), pa.array(np.full(size, self.part, np.int32)), pa.array(in_first), pa.array(edge),
             *[pa.array(np.full(size, int(c), np.int64)) for c in self.carry]],
            [*rows.column_names, *[f"__scan{i}" for i in range(len(out))], "__part", "__in_first", "__edge",
             *[f"__sum{i}" for i in range(len(out))]],
        )


def _both_nan(a: pa.Array, b: pa.Array) -> bool:
    return pa.types.is_floating(a.type) and bool(pc.is_nan(a)[0].as_py()) and bool(pc.is_nan(b)[0].as_py())


def _scanned(kinds: list[str], n_by: int, n_order: int, inclusive: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, waiting, done = _Scan(kinds, n_by, n_order, inclusive), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if waiting is None else pa.concat_tables([waiting, rows])
            keys = [c.combine_chunks() for c in rows.columns[:n_by + n_order]]
            last = int(np.flatnonzero(_fresh(keys))[-1])
            waiting = rows.slice(last)
            if last:
                if done is not None:
                    yield from done.to_batches()
                done = scan.batch(rows.slice(0, last))
        if waiting is not None:
            if done is not None:
                yield from done.to_batches()
            done = scan.batch(waiting)
            edge = done["__edge"].to_numpy().copy()
            edge[-1] |= _LAST
            done = done.set_column(done.column_names.index("__edge"), "__edge", pa.array(edge))
            yield from done.to_batches()

    return work


def _offsets(edges: list, n_by: int, kinds: list[str]) -> list[tuple]:
    """What each partition's first group has had in the partitions before: ``(part, offset0, ..)``."""
    out, carry, before = [], [KINDS[kind][1] for kind in kinds], None
    for row in edges:
        key = tuple(row[f"__key{i}"] for i in range(n_by))
        if row["__edge"] & _FIRST:
            same = before is not None and _same(before, key)
            offset = carry if same else [KINDS[kind][1] for kind in kinds]
            out.append((row["__part"], *map(int, offset)))
        if row["__edge"] & _LAST:
            own = [int(row[f"__sum{i}"]) for i in range(len(kinds))]
            # One group all along: what came before goes on.
            carry = [int(KINDS[kind][0](a, b)) for kind, a, b in zip(kinds, offset, own)] if row["__in_first"] else own
            before = key
    return out


def _same(a: tuple, b: tuple) -> bool:
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))


def scan(
    df: DataFrame, order: Sequence[str], values: Mapping[str, Column], by: Sequence[str] = (), kind: str = "sum",
    inclusive: bool = True, partitions: int | None = None,
) -> DataFrame:
    """Add running sums or maxima of integer ``values`` (output name -> column) along the ``order`` columns.

    Equal to the SQL window ``kind(value) OVER (PARTITION BY by ORDER BY order)``: NULL order values come first, peers share the
    value that includes them all, and with ``inclusive=False`` that of the rows before them (NULL before the first row for
    maxima, 0 for sums). NULL values add nothing. Sums that leave 64 bits wrap. Peers are held by one task while they are read:
    where very many rows may be equal in ``order``, add a column that tells them apart.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be 'sum' or 'max', got {kind!r}")
    if not order or not values:
        raise ValueError("name at least one order column and one value")
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    zero = F.lit(int(KINDS[kind][1])).cast("bigint")
    names = list(values)
    passed = [c for c in df.columns if c not in values]
    keys = [*(F.col(c).alias(f"__key{i}") for i, c in enumerate(by)), *(F.col(c).alias(f"__order{i}") for i, c in enumerate(order))]
    rows = df.select(
        *keys, *[F.coalesce(v.cast("bigint"), zero).alias(f"__value{i}") for i, v in enumerate(values.values())],
        *[F.col(c).alias(f"__pass{i}") for i, c in enumerate(passed)],
    )
    along = [f"__key{i}" for i in range(len(by))] + [f"__order{i}" for i in range(len(order))]
    dealt = rows.repartitionByRange(partitions, *along).sortWithinPartitions(*along)
    n = len(names)
    told = [f"{name} {kind_}" for name, kind_ in dealt.dtypes]
    told += [f"__scan{i} bigint" for i in range(n)] + ["__part int", "__in_first boolean", "__edge tinyint"]
    told += [f"__sum{i} bigint" for i in range(n)]
    folder = new_folder(spark, "scan")
    dealt.mapInArrow(_scanned([kind] * n, len(by), len(order), inclusive), ", ".join(told)).write.parquet(folder)
    stored = spark.read.parquet(folder)
    # Two rows for each partition.
    edges = stored.where("__edge > 0").select(
        *[f"__key{i}" for i in range(len(by))], "__part", "__in_first", "__edge", *[f"__sum{i}" for i in range(n)]
    ).collect()
    offsets = _offsets(sorted(edges, key=lambda r: (r["__part"], r["__edge"])), len(by), [kind] * n)
    known = spark.createDataFrame(offsets, ", ".join(["__part INT", *[f"__offset{i} BIGINT" for i in range(n)]]))
    joined = stored.join(F.broadcast(known), "__part")
    results = []
    for i, name in enumerate(names):
        text = f"__scan{i} + __offset{i}" if kind == "sum" else f"greatest(__scan{i}, __offset{i})"
        value = F.expr(f"CASE WHEN __in_first THEN {text} ELSE __scan{i} END")
        results.append((F.nullif(value, zero) if kind == "max" else value).alias(name))
    return joined.select(*[F.col(f"__pass{i}").alias(c) for i, c in enumerate(passed)], *results)
