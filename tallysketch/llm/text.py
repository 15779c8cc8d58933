"""Texts as flat byte arrays: what the operators share inside their tasks.

A batch of texts is ``data`` (all bytes, one text after the other) and ``offsets`` (where each begins, and the end). Null
texts count as empty. Words are runs of bytes other than space and 0x09 to 0x0D, and never cross texts.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_MIX = np.uint64(0xD6E8FEB86659FD93)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(32)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all 64 bits, one to one."""
    values = values ^ (values >> _HALF)
    values *= _MIX
    values ^= values >> _HALF
    values *= _MIX
    values ^= values >> _HALF
    return values


#: A random 64-bit number for each byte.
BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``offsets`` and ``data`` of a string or binary column."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``most`` bytes of text; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield batch.slice(begin, row - begin)
            begin, held = row, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def gathered(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Join and cut batches into runs of about ``most`` bytes of text."""
    waiting, held = [], 0
    for batch in batches:
        for part in slices(batch, column, most):
            size = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if waiting and held + size > most:
                yield _joined(waiting)
                waiting, held = [], 0
            waiting.append(part)
            held += size
    if waiting:
        yield _joined(waiting)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def word_bounds(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word, in order."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = begins[1:] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


_held: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Powers that a worker keeps; longer tables, for a long text, are made for it and dropped.
_KEPT = 3 << 20
#: Longer words are hashed by a digest: sums modulo 2^64 are equal for some long words made for it.
_LONG_WORD = 512


def _powers(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse."""
    if len(_held[0]) >= size:
        return _held
    made = []
    for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
        powers = np.full(max(size, min(size + size // 4 + 65536, _KEPT)), np.uint64(base))
        powers[0] = 1
        made.append(np.cumprod(powers))
    if len(made[0]) <= _KEPT:
        _held[:] = made
    return made


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of a sequence of 64-bit codes; equal spans have equal hashes wherever they stand."""
    up, down = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[:len(codes)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of words; ``fold`` takes A-Z as a-z."""
    data = LOWER[data] if fold else data
    hashes = span_hashes(BYTE_CODES[data], starts, ends)
    for word in np.flatnonzero(ends - starts > _LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[word]:ends[word]].tobytes(), digest_size=8).digest()
        hashes[word] = int.from_bytes(digest, "little")
    return hashes


def squeezed(raw: bytes) -> bytes:
    """Compressed bytes, their number in front."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def released(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)


def packed(values: np.ndarray, kind: str) -> bytes:
    """Numbers by byte place and compressed: leading zeros and places with few values cost next to nothing."""
    values = np.ascontiguousarray(values.astype(kind))
    return squeezed(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(released(raw), np.uint8).reshape(size, -1).T).view(kind).ravel()


def give_back() -> None:
    """Return what a worker has freed to the machine: the next operator's workers and the JVM share its memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
_table: dict = {}


def worker_table(name: tuple | None, make: Callable[[], object] | None = None) -> object:
    """What an operator keeps in a worker between tasks (a tokenizer, an automaton), made on first use.

    A worker serves one operator after the other, so it keeps one such table at a time: a task that asks for another, or
    for none (``None``), lets the one before go.
    """
    if name not in _table:
        _table.clear()
        give_back()
        if name is not None:
            _table[name] = make()
    return _table.get(name)


class Remembered:
    """A table of bounded size from words to what was made of them: what is in use stays, the rest is forgotten in turn.

    Two generations: when the young one holds ``most`` entries it becomes the old one, and entries that are asked for come
    back. Words longer than ``longest`` stay for one slice only.
    """

    def __init__(self, most: int, longest: int) -> None:
        self.most, self.longest = most, longest
        self.young: dict = {}
        self.old: dict = {}
        self.long: list = []

    def missing(self, words: set) -> list:
        """Begin a slice that needs ``words``: those that have to be made."""
        for word in self.long:
            self.young.pop(word, None)
        self.long = []
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        new = words.difference(self.young)
        back = {word: self.old[word] for word in new if word in self.old}
        self.young.update(back)
        return list(new.difference(back))

    def add(self, words: list, made: list) -> dict:
        """Add what was made of the missing words; the table now has all words of the slice."""
        self.young.update(zip(words, made))
        self.long = [word for word in words if len(word) > self.longest]
        return self.young
