"""Byte-level BPE by ranks: encode texts to ids and decode ids to bytes.

A pre-token is a linked list of symbols. Candidate merges wait in one bucket for each merge rank; which buckets hold
anything is kept in a bitmap of three levels, so find-first-set on three words gives the lowest rank. Entries whose symbols
have merged meanwhile are stale and skipped when they come up. A pre-token of n bytes costs O(n) queue steps, however
long it is. All new pre-tokens of a slice of
texts share one queue; those seen before are looked up in a table of bounded size. For a round trip that table holds
what becomes of a pre-token's ids too, so that a text is joined from its pre-tokens, not from its ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import query, read
from .text import Remembered, slices, worker_table

WORD_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Chunks remembered by a worker, and the longest that is remembered.
REMEMBERED = 600_000
LONGEST = 64
SLICE = 4 << 20


class RankQueue:
    """Positions by merge rank: buckets, and a bitmap of 64-bit words in three levels over the buckets in use."""

    def __init__(self, ranks: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((ranks >> 6) + 1)
        self.middle = [0] * ((ranks >> 12) + 1)
        self.high = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.middle[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.high |= 1 << (rank >> 12)
        else:
            bucket.append(position)

    def first(self) -> int:
        """The lowest rank in use, or -1."""
        if not self.high:
            return -1
        word = (self.high & -self.high).bit_length() - 1
        bits = self.middle[word]
        word = word << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[word]
        return word << 6 | (bits & -bits).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """Empty a rank's bucket: positions in ascending order."""
        bucket = self.buckets.pop(rank)
        self.low[rank >> 6] &= ~(1 << (rank & 63))
        if not self.low[rank >> 6]:
            self.middle[rank >> 12] &= ~(1 << (rank >> 6 & 63))
            if not self.middle[rank >> 12]:
                self.high &= ~(1 << (rank >> 12))
        bucket.sort()
        return bucket


class ByteBpe:
    """Encoder and decoder over a table of ranks; ``pattern`` cuts texts into pre-tokens.

    The pattern must begin a pre-token at each space between two characters that aren't white space, as all patterns of
    the kind `` ?\\p{L}+`` do: texts are looked up in such chunks.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.names = [str(i) for i in range(self.size)]
        self.letters = [ranks[bytes([i])] for i in range(256)]
        # The rank of two neighbours is that of their joined bytes: every way to cut a token in two tokens.
        self.pairs = {
            ranks[token[:i]] << 32 | ranks[token[i:]]: rank
            for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks
        }
        self.cut = regex.compile(pattern)
        self.alone = Remembered(REMEMBERED // 8, LONGEST)
        self.spaced = Remembered(REMEMBERED, LONGEST)
        self.trips = Remembered(REMEMBERED // 8, LONGEST), Remembered(REMEMBERED, LONGEST)

    def merged(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of pre-tokens, all merged through one queue: merges in one never touch another."""
        joined = b"".join(pieces)
        n, find = len(joined), self.pairs.get
        symbols = list(map(self.letters.__getitem__, joined))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ends, end = [], 0
        for piece in pieces:
            if piece:
                before[end] = -1
                end += len(piece)
                after[end - 1] = -1
            ends.append(end)
        queue = RankQueue(self.size)
        self._fill(queue, symbols, after)
        push, first, take, waiting = queue.push, queue.first, queue.take, queue.buckets.get
        while (rank := first()) >= 0:
            bucket = take(rank)
            for place, i in enumerate(bucket):
                j = after[i]
                # Stale: the symbol is gone, or it has another partner by now.
                if j < 0 or symbols[i] < 0 or find(symbols[i] << 32 | symbols[j]) != rank:
                    continue
                symbols[i], symbols[j] = rank, -1
                after[i] = k = after[j]
                lower = False
                if k >= 0:
                    before[k] = i
                    new = find(rank << 32 | symbols[k])
                    if new is not None:
                        if (others := waiting(new)) is None:
                            push(new, i)
                        else:
                            others.append(i)
                        lower = new < rank
                if (h := before[i]) >= 0:
                    new = find(symbols[h] << 32 | rank)
                    if new is not None:
                        if (others := waiting(new)) is None:
                            push(new, h)
                        else:
                            others.append(h)
                        lower = lower or new < rank
                if lower:  # what has just come up goes first
                    for i in bucket[place + 1:]:
                        push(rank, i)
                    break
        out, begin = [], 0
        for end in ends:
            out.append(tuple([s for s in symbols[begin:end] if s >= 0]))
            begin = end
        return out

    def _fill(self, queue: RankQueue, symbols: list[int], after: list[int]) -> None:
        """Queue every neighbouring pair that can merge."""
        codes = np.array(symbols, np.int64)
        here = np.flatnonzero(np.array(after, np.int64) >= 0)
        keys = (codes[here] << 32 | codes[here + 1]).tolist()
        ranks = np.fromiter((-1 if r is None else r for r in map(self.pairs.get, keys)), np.int64, len(keys))
        order = np.argsort(ranks, kind="stable")
        ranks, here = ranks[order], here[order]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
        for begin, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ranks)]):
            positions = here[begin:end].tolist()
            queue.push(int(ranks[begin]), positions[0])
            queue.buckets[int(ranks[begin])] = positions

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, no special tokens."""
        # A space between two characters that aren't white space begins a pre-token, so texts fall apart there.
        chunks = [WORD_SPACE.split(text) for text in texts]
        firsts = self._learned([[words[0]] for words in chunks], "", self.alone)
        rests = self._learned([words[1:] for words in chunks], " ", self.spaced)
        return [
            [*firsts[words[0]], *chain.from_iterable(map(rests.__getitem__, words[1:]))] for words in chunks
        ]

    def round_trips(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """Of each text: how many ids, the decimal ids joined by one space, and the bytes they decode to."""
        chunks = [WORD_SPACE.split(text) for text in texts]
        alone, spaced = self.trips
        firsts = self._learned([[words[0]] for words in chunks], "", alone, self._trip)
        rests = self._learned([words[1:] for words in chunks], " ", spaced, self._trip)
        for words in chunks:
            first = firsts[words[0]]
            counts, names, parts = zip(first, *map(rests.__getitem__, words[1:]))
            yield sum(counts), b"".join(names)[1:], b"".join(parts)

    def _trip(self, ids: tuple[int, ...]) -> tuple[int, bytes, bytes]:
        """Of a chunk: how many ids, each in decimal behind a space, and their bytes."""
        return len(ids), "".join([f" {i}" for i in ids]).encode(), self.decode(ids)

    def _learned(
        self, chunks: list[list[str]], before: str, known: Remembered, make: Callable[[tuple[int, ...]], tuple] = tuple,
    ) -> dict[str, tuple]:
        """What ``make`` makes of the ids of every chunk that stands in ``chunks``, each read with ``before`` in front of it."""
        new = known.missing(set().union(*chunks))
        cut = [self.cut.findall(before + chunk) for chunk in new]
        pieces = list(set().union(*cut))
        ids = dict(zip(pieces, self.merged([piece.encode() for piece in pieces])))
        return known.add(new, [make(tuple(chain.from_iterable(map(ids.__getitem__, parts)))) for parts in cut])

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def id_text(self, ids: list[int]) -> str:
        """Decimal ids joined by one space."""
        return " ".join(map(self.names.__getitem__, ids))


def load(path: str, pattern: str) -> ByteBpe:
    """The encoder of a rank file (lines of base64 token and rank)."""

    def make() -> ByteBpe:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return ByteBpe(ranks, pattern)

    return worker_table(("ranks", path, pattern), make)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``ids`` (array of int) of every row; null text has no ids. ``path`` is read on every machine."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                ids = bpe.encode_many([text or "" for text in part.column(1).to_pylist()])
                yield pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, n_tokens, ids_sha256, decoded_sha256, and n_bytes of the decoded text.

    Each text is encoded, the ids are decoded again, and digests of both leave the task: ids of whole texts need not be
    moved. Null text counts as empty; rows that repeat give repeated rows; an empty table gives none.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                counts, id_digests, text_digests, sizes = [], [], [], []
                for count, ids, decoded in bpe.round_trips([text or "" for text in part.column(1).to_pylist()]):
                    counts.append(count)
                    id_digests.append(hashlib.sha256(ids).hexdigest())
                    text_digests.append(hashlib.sha256(decoded).hexdigest())
                    sizes.append(len(decoded))
                yield pa.record_batch(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()),
                     pa.array(text_digests, pa.string()), pa.array(sizes, pa.int64())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"
    )


@query()
def op5_byte_bpe(spark, folder):
    """Every document through the public rank file and back."""
    import public_tokenizers

    return round_trip(
        read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
