"""Pack tokenized documents into sequences of a fixed capacity.

Lengths are integers up to the capacity, so the whole instance is a histogram with at most ``capacity`` rows: that, and
never the documents, is what the driver sees. Martello and Toth's dominance reduction fixes sets of one to three
lengths that no other set holding the same longest document can beat; best fit over runs of equal lengths packs the
rest. The outcome is a list of patterns. Each piece finds its place by its rank among pieces of its length, and ranks
are counted in blocks, so a length that very many documents share is no single task's work.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import new_folder
from .catalog import query, read
from .text import Remembered, slices, worker_table

#: Words remembered by a worker, and the longest that is remembered.
REMEMBERED = 700_000
LONGEST = 64
SLICE = 4 << 20
#: Pieces of one length that are numbered in one group.
BLOCK = 1024

Pattern = dict[int, int]


# Tokens


class WordTokens:
    """Token ids (little-endian 32-bit) of texts by a tokenizer that drops white space and never joins across it."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known = Remembered(REMEMBERED, LONGEST)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        words = [_lower(text).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for text in texts]
        new = self.known.missing(set().union(*words))
        ids = self.known.add(new, self._ids(new))
        return [b"".join(map(ids.__getitem__, parts)) for parts in words]

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word, all read in one call: tokens go to the word in which they begin."""
        if not words:
            return []
        out = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(out.ids, "<u4")
        begins = np.array(out.offsets, np.int64).reshape(-1, 2)[:, 0]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        cuts = np.searchsorted(begins, ends).tolist()
        raw, out, at = ids.tobytes(), [], 0
        for cut in cuts:
            out.append(raw[4 * at:4 * cut])
            at = cut
        return out


def _lower(text: str) -> str:
    """A-Z as a-z, as the tokenizer will anyway; not beside combining marks, where case decides what composes."""
    raw = text.encode()
    return text if b"\xcc" in raw or b"\xcd" in raw else raw.lower().decode()


def load(path: str) -> WordTokens:
    return worker_table(("words", path), lambda: WordTokens(path))


def token_pieces(
    docs: DataFrame, path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and one end id, cut where longer than ``capacity``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = load(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                rows = []
                names = part.column(0).to_pylist()
                for name, ids in zip(names, tokens.encode_many([t or "" for t in part.column(1).to_pylist()])):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at:at + 4 * capacity]
                        rows.append((name, piece, at // 4, len(own) // 4, zlib.crc32(own)))
                columns = list(zip(*rows)) or [()] * 5
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


# Patterns


def dominating(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Sets that some optimal packing holds, each with how often, and the lengths that are left.

    A set with longest document j dominates another if the other's documents besides j fit into the places of its own.
    """
    left = dict(counts)
    fixed: list[tuple[Pattern, int]] = []
    again = True
    while again:
        again = False
        for longest in sorted(left, reverse=True):
            while left.get(longest, 0):
                rest = _dominant(left, longest, capacity)
                if rest is None:
                    break
                pattern = {longest: 1}
                for length in rest:
                    pattern[length] = pattern.get(length, 0) + 1
                times = min(left[length] // n for length, n in pattern.items())
                fixed.append((pattern, times))
                for length, n in pattern.items():
                    left[length] -= n * times
                    if not left[length]:
                        del left[length]
                again = True
    return fixed, left


def _dominant(left: dict[int, int], longest: int, capacity: int) -> tuple[int, ...] | None:
    """What goes with one document of the longest length in a dominating set, or None if no rule applies."""
    room = capacity - longest
    others = dict(left)
    others[longest] -= 1
    lengths = sorted(length for length, n in others.items() if n and length <= room)
    if not lengths:
        return ()
    big = lengths[-1]
    smallest = [length for length in lengths[:3] for _ in range(min(3, others[length]))][:3]
    if big == room or len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return (big,)
    if len(smallest) == 3 and sum(smallest) <= room:
        return None
    # At most two more fit. One document as long as the best pair can't be beaten by a pair.
    best, low = 0, 0
    for high in range(len(lengths) - 1, -1, -1):
        while low <= high and lengths[low] + lengths[high] <= room:
            low += 1
        mate = min(low - 1, high)
        if mate >= 0 and (mate < high or others[lengths[high]] > 1):
            best = max(best, lengths[high] + lengths[mate])
        elif mate == high and mate > 0:
            best = max(best, lengths[high] + lengths[mate - 1])
    if big >= best:
        return (big,)
    # The longest with the longest beside it, unless some pair has a shorter member that is longer than that.
    others[big] -= 1
    beside = [length for length in lengths if length <= room - big and others[length]]
    if not beside:
        return None
    others[big] += 1
    above = [length for length in lengths if length > beside[-1] for _ in range(min(2, others[length]))][:2]
    if len(above) < 2 or sum(above) > room:
        return (big, beside[-1])
    return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit, longest first, for all documents of a length at once: sequences with equal room are kept as one class."""
    classes: dict[int, list[tuple[Pattern, int]]] = {}

    def put(room: int, pattern: Pattern, times: int) -> None:
        if times:
            classes.setdefault(room, []).append((pattern, times))

    for length in sorted(counts, reverse=True):
        waiting = counts[length]
        rooms = sorted(classes)
        for room in rooms[bisect_right(rooms, length - 1):]:
            if not waiting:
                break
            each = room // length
            for pattern, times in classes.pop(room):
                full = min(times, waiting // each)
                put(room - each * length, pattern | {length: each}, full)
                waiting -= full * each
                if full < times and waiting:
                    put(room - waiting * length, pattern | {length: waiting}, 1)
                    full, waiting = full + 1, 0
                put(room, pattern, times - full)
        each = capacity // length
        put(capacity - each * length, {length: each}, waiting // each)
        if waiting % each:
            put(capacity - waiting % each * length, {length: waiting % each}, 1)
    return [entry for entries in classes.values() for entry in entries]


def places(patterns: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, first offset, documents of the length in a sequence)."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length, each in pattern.items():
            rank = used.get(length, 0)
            rows.setdefault(length, []).append((rank, sequence, offset, each))
            used[length] = rank + each * times
            offset += each * length
        sequence += times
    return {length: np.array(own, np.int64) for length, own in rows.items()}


# The whole


def pack(
    docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``path`` is a tokenizer file of a kind that drops white space. Null text is empty and packs as the end id alone;
    rows that repeat are packed each; a null id is kept; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "pieces")
    # Tokenized once: the histogram, the ranks and the result read the small table.
    token_pieces(docs, path, capacity, id_col, text_col).write.parquet(folder)
    pieces = spark.read.parquet(folder)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    fixed, left = dominating(counts, capacity)
    found = places(fixed + best_fit(left, capacity))

    # One row for each length: no more than the capacity.
    ways = spark.createDataFrame([(length, 1 + n // BLOCK) for length, n in counts.items()], "length long, __ways long")
    dealt = pieces.join(F.broadcast(ways), "length").withColumn(
        "__block", F.pmod(F.xxhash64("doc_id", "piece"), F.col("__ways"))
    )
    before = Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "__block").count().select(
        "length", "__block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"),
    )
    inside = Window.partitionBy("length", "__block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("__rank", F.row_number().over(inside) - 1).join(starts, ["length", "__block"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("__before") + F.col("__rank")).alias("__rank"),
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths).tolist():
                own = lengths == length
                rows = found[length]
                row = rows[np.searchsorted(rows[:, 0], ranks[own], "right") - 1]
                turn = ranks[own] - row[:, 0]
                sequence[own] = row[:, 1] + turn // row[:, 3]
                offset[own] = row[:, 2] + turn % row[:, 3] * length
            yield pa.record_batch(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


@query()
def op8_best_fit_packing(spark, folder):
    """All documents in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
