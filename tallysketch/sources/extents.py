"""Raw extents: files of little-endian 32-bit keys, read by byte offset and length.

``spark.read.format("u32le")`` takes a file or folder (its files in name order form one address range) and the options
``offset``, ``length`` and ``chunk``; every chunk is one input partition.  ``df.write.format("u32le")`` writes one such
file per task, and beside it the smallest and largest key of every ``step`` bytes.

The options ``lowest_key`` and ``highest_key`` return keys in between only, and only steps that can hold such keys are planned.
Files without ranges, or whose ranges are of another size than the file, are read whole. (Filters are not pushed down by
themselves: Spark keeps what one query has pushed to a Python source for all queries of the same DataFrame, which then
miss rows.)
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "u32le"
KEY_BYTES = 4
DEFAULT_CHUNK = 128 << 20
READ_BYTES = 4 << 20
SUFFIX = ".u32"
RANGES = ".ranges"
DEFAULT_STEP = 16 << 20
LARGEST = (1 << 32) - 1


def _file_system(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _pieces(path: str) -> list[tuple[str, int]]:
    """Files of an address range in order, with their sizes."""
    from pyarrow import fs

    system, root = _file_system(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = system.get_file_info(fs.FileSelector(root, recursive=False))
    return sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and f.base_name.endswith(SUFFIX))


@dataclass
class Span(InputPartition):
    """Part of one file, and where it lies in the whole address range."""

    file: str
    start: int
    size: int
    address: int


def plan_spans(pieces: list[tuple[str, int]], offset: int, length: int | None, chunk: int) -> list[Span]:
    """Cut ``[offset, offset + length)`` of the concatenated files into spans of whole keys, at most ``chunk`` bytes.

    One to three bytes at the end that make no whole key are not read.
    """
    if offset < 0 or offset % KEY_BYTES or (length is not None and length < 0):
        raise ValueError(f"offset must be a non-negative multiple of {KEY_BYTES} and length non-negative")
    if any(size % KEY_BYTES for _, size in pieces[:-1]):
        raise ValueError("only the last file may end inside a key")
    chunk = max(KEY_BYTES, chunk - chunk % KEY_BYTES)
    total = sum(size for _, size in pieces)
    end = total if length is None else min(total, offset + length)
    end -= (end - offset) % KEY_BYTES if end > offset else 0
    spans, base = [], 0
    for file, size in pieces:
        low, high = max(offset, base), min(end, base + size)
        for start in range(low, high, chunk):
            spans.append(Span(file, start - base, min(chunk, high - start), start))
        base += size
    return spans


class KeyRanges:
    """Smallest and largest key of every ``step`` bytes of a file, gathered while it is written."""

    def __init__(self, step: int) -> None:
        self.step, self.keys, self.low, self.high = step, 0, [], []

    def add(self, keys: np.ndarray) -> None:
        if not len(keys):
            return
        per_step = self.step // KEY_BYTES
        fresh = np.arange(-self.keys % per_step, len(keys), per_step)
        cuts = np.unique(np.append(0, fresh))
        low, high = np.minimum.reduceat(keys, cuts).tolist(), np.maximum.reduceat(keys, cuts).tolist()
        if self.keys % per_step:
            self.low[-1], self.high[-1] = min(self.low[-1], low.pop(0)), max(self.high[-1], high.pop(0))
        self.low += low
        self.high += high
        self.keys += len(keys)

    def to_bytes(self) -> bytes:
        """Step and file size as 64-bit numbers, then all smallest and all largest keys."""
        head = np.array([self.step, self.keys * KEY_BYTES], "<u8").tobytes()
        return head + np.array([self.low, self.high], "<u4").tobytes()


def _stored_ranges(path: str, file: str, size: int) -> tuple[int, np.ndarray, np.ndarray] | None:
    """Step, smallest and largest keys of a file; None where none are stored for a file of this size."""
    from pyarrow import fs

    system, _ = _file_system(path)
    if system.get_file_info(file + RANGES).type != fs.FileType.File:
        return None
    with system.open_input_stream(file + RANGES) as stored:
        data = stored.read()
    step, told = (int(n) for n in np.frombuffer(data[:16], "<u8"))
    if told != size:
        return None
    low, high = np.frombuffer(data[16:], "<u4").reshape(2, -1)
    return step, low, high


def matching_parts(span: Span, step: int, wanted: np.ndarray) -> list[Span]:
    """The parts of a span that lie in wanted steps of its file; neighbouring steps stay together."""
    first = span.start // step
    flags = wanted[first : -(-(span.start + span.size) // step)].astype(np.int8)
    edges = np.flatnonzero(np.diff(flags, prepend=0, append=0)) + first
    parts = []
    for begin, end in zip((edges[::2] * step).tolist(), (edges[1::2] * step).tolist()):
        start, stop = max(begin, span.start), min(end, span.start + span.size)
        parts.append(Span(span.file, start, stop - start, span.address + start - span.start))
    return parts


class ExtentReader(DataSourceReader):
    def __init__(
        self, path: str, offset: int, length: int | None, chunk: int, low: int = 0, high: int = LARGEST
    ) -> None:
        self.path, self.offset, self.length, self.chunk, self.low, self.high = path, offset, length, chunk, low, high
        self.all_keys = low <= 0 and high >= LARGEST

    def partitions(self) -> list[Span]:
        if self.low > self.high:
            return []
        pieces = _pieces(self.path)
        spans = plan_spans(pieces, self.offset, self.length, self.chunk)
        if self.all_keys:
            return spans
        read = {span.file for span in spans}
        ranges = {file: _stored_ranges(self.path, file, size) for file, size in pieces if file in read}
        wanted = {f: (r[0], (r[1] <= self.high) & (r[2] >= self.low)) for f, r in ranges.items() if r is not None}
        return [p for span in spans for p in (matching_parts(span, *wanted[span.file]) if span.file in wanted else [span])]

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty range is planned as one partition without a span
            return
        system, _ = _file_system(self.path)
        with system.open_input_file(partition.file) as file:
            done = 0
            while done < partition.size:
                data = file.read_at(min(READ_BYTES, partition.size - done), partition.start + done)
                if not data:
                    raise EOFError(f"{partition.file} ended early")
                if len(data) % KEY_BYTES:
                    data = data[: len(data) - len(data) % KEY_BYTES]
                keys = np.frombuffer(data, "<u4").astype(np.int64)
                addresses = np.arange(len(keys), dtype=np.int64) * KEY_BYTES + partition.address + done
                if not self.all_keys:
                    inside = (keys >= self.low) & (keys <= self.high)
                    keys, addresses = keys[inside], addresses[inside]
                yield pa.RecordBatch.from_arrays([pa.array(addresses), pa.array(keys)], ["address", "key"])
                done += len(data)


@dataclass
class WrittenFile(WriterCommitMessage):
    name: str


class ExtentWriter(DataSourceArrowWriter):
    """Each task attempt writes its own hidden file; the commit reveals the files of the attempts that counted.

    File names begin with the number of the write, so keys that are appended lie behind all that were there before, and
    no address changes.
    """

    def __init__(self, path: str, overwrite: bool, step: int = DEFAULT_STEP) -> None:
        if step < KEY_BYTES or step % KEY_BYTES:
            raise ValueError(f"step must be a positive multiple of {KEY_BYTES}")
        self.path, self.overwrite, self.step = path, overwrite, step
        system, root = _file_system(path)
        system.create_dir(root, recursive=True)
        numbers = [int(n[1]) for file, _ in _pieces(path) if (n := re.search(rf"part-(\d+)-[^/]*{SUFFIX}$", file))]
        self.token = f"{1 + max(numbers, default=-1):08d}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFile:
        from pyspark import TaskContext

        system, root = _file_system(self.path)
        number, token = self.token.split("-")
        name = f"part-{number}-{TaskContext.get().partitionId():08d}-{token}-{uuid.uuid4().hex}{SUFFIX}"
        ranges = KeyRanges(self.step)
        with system.open_output_stream(f"{root}/_{name}.pending") as out:
            for batch in iterator:
                column = batch.column(batch.schema.get_field_index("key"))
                keys = column.fill_null(-1).to_numpy(zero_copy_only=False)
                if len(keys) and (keys.min() < 0 or keys.max() >> 32):
                    raise ValueError("keys must be non-NULL and inside 0..2^32-1")
                out.write(keys.astype("<u4").tobytes())
                ranges.add(keys)
        with system.open_output_stream(f"{root}/_{name}{RANGES}.pending") as out:
            out.write(ranges.to_bytes())
        return WrittenFile(name)

    def commit(self, messages: list[WrittenFile]) -> None:
        system, root = _file_system(self.path)
        old = [file for file, _ in _pieces(self.path)] if self.overwrite else []
        for message in messages:
            if message is not None:
                # Ranges first: a file that can be seen has them.
                for name in (message.name + RANGES, message.name):
                    system.move(f"{root}/_{name}.pending", f"{root}/{name}")
        for file in old:
            system.delete_file(file)
            if system.get_file_info(file + RANGES).is_file:
                system.delete_file(file + RANGES)
        self._clear()

    def abort(self, messages: list[WrittenFile]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Delete what attempts of this write have left that did not count."""
        from pyarrow import fs

        system, root = _file_system(self.path)
        token = self.token.split("-")[1]
        for file in system.get_file_info(fs.FileSelector(root, recursive=False)):
            if file.base_name.endswith(".pending") and f"-{token}-" in file.base_name:
                system.delete_file(file.path)


class ExtentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "address BIGINT, key BIGINT"

    def reader(self, schema) -> ExtentReader:
        length = self.options.get("length")
        return ExtentReader(
            self.options["path"],
            int(self.options.get("offset", 0)),
            None if length is None else int(length),
            int(self.options.get("chunk", DEFAULT_CHUNK)),
            int(self.options.get("lowest_key", 0)),
            int(self.options.get("highest_key", LARGEST)),
        )

    def writer(self, schema, overwrite: bool) -> ExtentWriter:
        return ExtentWriter(self.options["path"], overwrite, int(self.options.get("step", DEFAULT_STEP)))


def read_extent(
    spark: SparkSession, path: str, offset: int = 0, length: int | None = None, chunk: int = DEFAULT_CHUNK,
    lowest_key: int = 0, highest_key: int = LARGEST,
) -> DataFrame:
    """Keys of a byte range as ``(address, key)``, those between the two given ones only."""
    spark.dataSource.register(ExtentSource)
    reader = spark.read.format(FORMAT).option("offset", offset).option("chunk", chunk)
    reader = reader.option("lowest_key", lowest_key).option("highest_key", highest_key)
    if length is not None:
        reader = reader.option("length", length)
    return reader.load(path)


def write_extent(keys: DataFrame, path: str, mode: str = "append", step: int = DEFAULT_STEP) -> None:
    """Write a ``key`` column as raw little-endian files, with the range of keys of every ``step`` bytes."""
    keys.sparkSession.dataSource.register(ExtentSource)
    keys.select("key").write.format(FORMAT).mode(mode).option("step", step).save(path)
