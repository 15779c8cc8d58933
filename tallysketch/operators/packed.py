"""Sketches as one packed binary per group: few registers as sorted pairs, many as six (or eight) bits each.

A register table has a row of group, bucket and rank for each register; a packed sketch is one row for each group, at most
``2^p`` bytes, and merging is a byte maximum over whole arrays. Use it where groups are many and stored for long; the register
table stays the form to build, as its aggregation spreads one huge group over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import get_hash
from .estimate import WORD_BITS, finish, words_for
from .registers import check_groups, check_p, register_count

#: First byte of a packed sketch: pairs of bucket and rank, six bits for each register, or eight.
SPARSE, SIX, EIGHT = 0, 1, 2
#: Packed sketches of a group that meet in one task before the last merge: salts of the first.
SALTS = 64


def pack(registers: np.ndarray) -> bytes:
    """The smallest of the forms for an array of ``2^p`` ranks."""
    used = np.flatnonzero(registers)
    wide = bool((registers > 63).any())
    if 3 * len(used) < len(registers) * (8 if wide else 6) // 8:
        return bytes([SPARSE]) + used.astype("<u2").tobytes() + registers[used].astype(np.uint8).tobytes()
    if wide:
        return bytes([EIGHT]) + registers.astype(np.uint8).tobytes()
    four = registers.astype(np.uint32).reshape(-1, 4)
    joined = four[:, 0] | four[:, 1] << 6 | four[:, 2] << 12 | four[:, 3] << 18
    return bytes([SIX]) + np.ascontiguousarray(joined.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def unpack(raw: bytes, p: int) -> np.ndarray:
    kind, body = raw[0], np.frombuffer(raw, np.uint8, offset=1)
    if kind == EIGHT:
        return body.copy()
    if kind == SPARSE:
        used = len(body) // 3
        registers = np.zeros(register_count(p), np.uint8)
        registers[body[:2 * used].view("<u2")] = body[2 * used:]
        return registers
    three = body.reshape(-1, 3).astype(np.uint32)
    joined = three[:, 0] | three[:, 1] << 8 | three[:, 2] << 16
    return np.stack([joined >> shift & 63 for shift in (0, 6, 12, 18)], axis=1).astype(np.uint8).ravel()


def _group(by: Sequence[str]) -> Column:
    """One struct of the group columns, so that NULLs are equal; without groups a constant."""
    return F.struct(*by) if by else F.struct(F.lit(0).alias("__all"))


def pack_registers(registers: DataFrame, p: int, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., packed)`` of a register table; a task packs the at most ``2^p`` registers of a group."""
    check_p(p)
    check_groups(by)

    def work(table: pa.Table) -> pa.Table:
        own = np.zeros(register_count(p), np.uint8)
        ranks = table["rank"].to_numpy()
        live = ranks > 0  # a group without keys has one row of rank 0 without a bucket
        own[table["bucket"].to_numpy()[live].astype(np.int64)] = ranks[live]
        return table.select(["__group"]).slice(0, 1).append_column("packed", pa.array([pack(own)], pa.binary()))

    rows = registers.select(_group(by).alias("__group"), "bucket", "rank")
    kind = rows.schema["__group"].dataType.simpleString()
    packed = rows.groupBy("__group").applyInArrow(work, f"__group {kind}, packed binary")
    return packed.select(*[F.col("__group")[c].alias(c) for c in by], "packed")


def _folded(p: int):
    """Byte maxima of neighbouring rows of one group, in a sorted partition: one array is held at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def row():
            return pa.RecordBatch.from_arrays([key, pa.array([pack(held)], pa.binary())], ["__group", "packed"])

        for batch in batches:
            for at in range(batch.num_rows):
                own, registers = batch.column("__group").slice(at, 1), unpack(batch.column("packed")[at].as_py(), p)
                if key is not None and own.equals(key):
                    np.maximum(held, registers, out=held)
                else:
                    if key is not None:
                        yield row()
                    key, held = own, registers
        if key is not None:
            yield row()

    return work


def merge_packed(*tables: DataFrame, p: int, by: Sequence[str] = ()) -> DataFrame:
    """Largest rank per register over packed tables; dropping a column from ``by`` rolls up along it.

    A group's sketches are folded in ``SALTS`` parts first, so that one task sees at most that many of any group.
    """
    check_p(p)
    together = None
    for table in tables:
        rows = table.select(_group(by).alias("__group"), "packed")
        together = rows if together is None else together.unionByName(rows)
    kind = together.schema["__group"].dataType.simpleString()
    partitions = int(together.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = together.withColumn("__salt", F.pmod(F.xxhash64("packed"), F.lit(SALTS)))
    for keys in (["__group", "__salt"], ["__group"]):
        dealt = salted.repartition(partitions, *keys).sortWithinPartitions("__group")
        salted = dealt.select("__group", "packed").mapInArrow(_folded(p), f"__group {kind}, packed binary")
    return salted.select(*[F.col("__group")[c].alias(c) for c in by], "packed")


def estimate_packed(packed: DataFrame, p: int, hash: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., estimate, zeros, harmonic, raw)``, the same numbers as from the registers."""
    words = words_for(get_hash(hash).width)
    names = [f"word{i}" for i in range(words)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [register_words(unpack(raw.as_py(), p), words) for raw in batch.column("packed")]
            columns = zip(*sums) if sums else [()] * (words + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__group"), *[pa.array(c, pa.int64()) for c in columns]], ["__group", "nonempty", *names])

    rows = packed.select(_group(by).alias("__group"), "packed")
    kind = rows.schema["__group"].dataType.simpleString()
    told = ", ".join([f"__group {kind}", "nonempty bigint", *[f"{name} bigint" for name in names]])
    sums = rows.mapInArrow(work, told)
    return finish(sums.select(*[F.col("__group")[c].alias(c) for c in by], "nonempty", *names), p, words, by)


def register_words(registers: np.ndarray, words: int) -> tuple[int, ...]:
    """Registers in use, and the harmonic sum in integer words as ``estimate`` keeps it."""
    counts = np.bincount(registers, minlength=1)
    sums = [
        sum(int(counts[r]) << WORD_BITS * (i + 1) - r for r in range(WORD_BITS * i + 1, min(WORD_BITS * (i + 1) + 1, len(counts))))
        for i in range(words)
    ]
    return int(np.count_nonzero(registers)), *sums
