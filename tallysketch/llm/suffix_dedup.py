"""Repeated passages: suffix order and longest previous factors, bucket by bucket.

A byte goes when it lies in a ``length``-byte string that also starts in a document with a smaller id. Three steps:

1. Anchors. A text that an earlier document has from end to end goes as a whole. In the others, each window of ``length`` bytes is assigned the smallest hash of its ``GRAM``-byte substrings; equal windows
   have equal anchors, and neighbouring windows mostly share one, so a text is a few runs of windows per hundred bytes.
   Runs are dealt by anchor as packed arrays, and only anchors that two documents have go on. An anchor that several
   documents of one task's batch have is known there already: its runs pass on, and one witness goes to the anchor's
   bucket, so an anchor that a third of all documents have brings one row for each batch.
2. Longest previous factors. The bytes of the runs that are left meet by anchor. Windows are sorted into suffix order
   to depth ``length``, equal ones by position; a window's previous smaller position in that order is the first of
   its equals, and its factor is long enough where that one lies in an earlier document. Equal runs within a batch are
   collapsed before. Anchors with very many runs are dealt by whole windows instead.
3. Removal. Marked windows of a document are merged into spans and cut from its text.

Strings are judged on the input, not on what is left. Every window of every text takes part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import new_folder
from .catalog import query, read
from .text import BYTE_CODES, flat, gathered, give_back, mixed, packed, released, span_hashes, squeezed, unpacked, worker_table

GRAM = 16
LENGTH = 50
SLICE = 2 << 20
#: Runs to a bucket, on average; an anchor with more runs than HOT (or its share of four million) is dealt by windows.
BUCKET = 1 << 18
HOT = 1 << 18
HOT_KEYS = 4_000_000
#: Most windows to a run, as their number has 16 bits where runs are packed; longer ones are several of the same anchor.
WINDOWS = (1 << 16) - 1
#: Ids that may be broadcast; more are joined by a shuffle.
FEW = 1_000_000
#: Parts of one id (rows that repeat it) are this far apart.
PART = 1 << 32
#: What a null id counts as: the largest.
LAST = 2 ** 63 - 1
#: Slots that the rows of a repeated id are numbered in.
SLOTS = 1 << 16


# Runs of windows


def anchors(offsets: np.ndarray, data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: anchor (48 bits), text number, first window's place in ``data``, number of windows."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none
    hashes, width = BYTE_CODES[data], 1
    while width < GRAM:
        hashes = hashes[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + hashes[width:]
        width *= 2
    least, width, want = mixed(hashes), 1, length - GRAM + 1
    while width * 2 <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[:width - want], least[want - width:])
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    if not len(owner):
        return none.astype(np.uint64), none, none, none
    windows = np.maximum(sizes - length + 1, 0)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    places = offsets[owner] + within
    own = least[places]
    first = np.ones(len(own), bool)
    first[1:] = (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])
    begins = np.flatnonzero(first)
    counts = np.diff(np.append(begins, len(own)))
    pieces = -(-counts // WINDOWS)
    if (pieces > 1).any():
        piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begins = np.repeat(begins, pieces) + piece * WINDOWS
        counts = np.diff(np.append(begins, len(own)))
    return mixed(own[begins]) >> np.uint64(16), owner[begins], places[begins], counts


def _anchor_rows(buckets: int, length: int, batch: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_table(None)
        held, size = [], 0
        for part in gathered(batches, 2, SLICE):
            offsets, data = flat(part.column(2))
            keys, owner, places, counts = anchors(offsets, data, length)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            shift = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64) * PART
            held.append((keys, ids[owner], places - offsets[owner] + shift[owner], counts))
            size += len(keys)
            if size >= batch:
                yield from _by_bucket(held, buckets)
                held, size = [], 0
        if size:
            yield from _by_bucket(held, buckets)
        held.clear()
        give_back()

    return work


def _by_bucket(held: list[tuple[np.ndarray, ...]], buckets: int) -> Iterator[pa.RecordBatch]:
    keys, docs, starts, counts = map(np.concatenate, zip(*held))
    order = np.lexsort((docs, keys))
    keys, docs, starts, counts = keys[order], docs[order], starts[order], counts[order]
    group, first, last = _groups(keys)
    shared = (docs[first] != docs[last - 1])[group]
    sizes = (last - first)[group]
    # One witness of each shared anchor goes to its bucket; the runs themselves are known to be shared.
    sent = ~shared
    sent[first] = True
    bucket = ((keys[sent] >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    rows = []
    own = (keys[sent], docs[sent], starts[sent], np.where(shared[sent], 0, counts[sent]), sizes[sent])
    for number, a, b in _pieces(bucket):
        rows.append((number, *[packed(c[a:b], k) for c, k in zip(own, ("<u8", "<i8", "<i8", "<i4", "<i4"))]))
    passing = (keys[shared], docs[shared], starts[shared], counts[shared], sizes[shared])
    for a in range(0, int(shared.sum()), BUCKET // 8):
        b = a + BUCKET // 8
        number = buckets + int(keys[0] % np.uint64(buckets)) + a
        rows.append((number, *[packed(c[a:b], k) for c, k in zip(passing, ("<u8", "<i8", "<i8", "<i4", "<i4"))]))
    names = ["bucket", "keys", "docs", "starts", "counts", "sizes"]
    yield pa.record_batch(
        [pa.array(c, pa.int64() if n == "bucket" else pa.binary()) for n, c in zip(names, zip(*rows))], names
    )


def _pieces(sorted_numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Number, begin and end of each stretch of equal numbers."""
    if len(sorted_numbers):
        _, first, last = _groups(sorted_numbers)
        yield from zip(sorted_numbers[first].tolist(), first.tolist(), last.tolist())


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: each one's group number, and each group's begin and end."""
    change = np.ones(len(keys), bool)
    change[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(change)
    return np.cumsum(change) - 1, first, np.append(first[1:], len(keys))


def _tail(keys: np.ndarray, counts: np.ndarray | int) -> np.ndarray:
    """32 bits of the anchor, enough to bring equal ones together, and the number of windows, in one number."""
    return (keys >> np.uint64(16)).astype(np.int64) << 16 | counts


def _shared_runs(buckets: int, hot_runs: int) -> Callable[[pa.Table], pa.Table]:
    """Of a bucket: the runs whose anchor another document has, and for each anchor how many runs it has in all."""
    kinds = (("keys", "<u8"), ("docs", "<i8"), ("starts", "<i8"), ("counts", "<i4"), ("sizes", "<i4"))

    def work(table: pa.Table) -> pa.Table:
        keys, docs, starts, counts, sizes = (
            np.concatenate([unpacked(raw, kind) for raw in table[name].to_pylist()]) for name, kind in kinds
        )
        if table["bucket"][0].as_py() < buckets:
            order = np.lexsort((docs, keys))
            keys, docs, starts, counts, sizes = (c[order] for c in (keys, docs, starts, counts, sizes))
            group, first, last = _groups(keys)
            # A witness (no windows of its own) stands for a shared anchor.
            shared = (docs[first] != docs[last - 1]) | (np.minimum.reduceat(counts, first) == 0)
            own = shared[group] & (counts > 0)
            # One entry in a batch counts for itself; a witness for all entries of its batch.
            total = np.add.reduceat(np.where(counts == 0, sizes, 1), first)
            hot = shared & (total > hot_runs)
            # A mark of a hot anchor has no document.
            mark = np.append(np.zeros(int(own.sum()), bool), np.ones(int(hot.sum()), bool))
            return pa.table({
                "doc": pa.array(np.append(docs[own], np.zeros(int(hot.sum()), np.int64)), mask=mark),
                "start": np.concatenate([starts[own], total[hot]]),
                "tail": np.concatenate([_tail(keys[own], counts[own]), _tail(keys[first[hot]], 0)]),
            })
        return pa.table({"doc": docs, "start": starts, "tail": _tail(keys, counts)})

    return work


# Suffix order


def suffix_order(data: np.ndarray, starts: np.ndarray, tie: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``length`` bytes, equal ones by ``tie``; and for each place in
    that order whether its suffix differs from the one before within that depth."""
    places = [*range(0, length - 7, 8)]
    if places[-1] + 8 < length:
        places.append(length - 8)
    stretched = np.lib.stride_tricks.sliding_window_view(data, 8)

    def word(at: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(stretched[at]).view(">u8").ravel().astype(np.uint64)

    order = np.arange(len(starts))
    differs = np.ones(len(starts), bool)
    differs[1:] = False
    for place in places:
        # Only suffixes that are still equal to a neighbour are looked at further.
        group = np.cumsum(differs) - 1
        tied = np.bincount(group)[group] > 1
        at = np.flatnonzero(tied)
        if not len(at):
            break
        own = order[at]
        values = word(starts[own] + place)
        turn = np.lexsort((values, group[at]))
        order[at] = own[turn]
        values, groups = values[turn], group[at][turn]
        differs[at[1:]] |= (values[1:] != values[:-1]) & (groups[1:] == groups[:-1])
    group = np.cumsum(differs) - 1
    order = order[np.lexsort((tie[order], group))]
    return order, differs


def _earlier(table: pa.Table, length: int) -> pa.Table:
    """Of a bucket of runs with their bytes: windows whose longest previous factor in an earlier document is long enough,
    as spans; runs without bytes are known to be repeats already."""
    docs, starts, counts, keys = (
        np.concatenate([unpacked(raw, "<i8") for raw in table[name].to_pylist()]) for name in PACKED
    )
    data = np.frombuffer(b"".join(map(released, table["text"].to_pylist())), np.uint8)
    done = counts < 0
    counts = np.abs(counts)
    sizes = np.where(done, 0, counts + length - 1)
    offsets = np.cumsum(sizes) - sizes
    # Runs of different batches may be equal too: the later documents' are repeats as a whole.
    left = np.flatnonzero(~done)
    codes = span_hashes(BYTE_CODES[data], offsets[left], offsets[left] + sizes[left])
    done[left] = _later_copies(docs[left], starts[left], sizes[left], offsets[left], codes, data)
    spans = [(docs[done], starts[done], starts[done] + counts[done])]
    # Anchors that only one document has left have nothing to be compared with.
    order = np.lexsort((docs, keys))
    order = order[~done[order]]
    if len(order):
        group, first, last = _groups(keys[order])
        several = docs[order[first]] != docs[order[last - 1]]
        order = order[several[group]]
    if len(order):
        number = counts[order]
        within = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        places = np.repeat(offsets[order], number) + within
        owners, at = np.repeat(docs[order], number), np.repeat(starts[order], number) + within
        rank = np.empty(len(at), np.int64)
        rank[np.lexsort((at, owners))] = np.arange(len(at))
        suffixes, differs = suffix_order(data, places, rank, length)
        heads = np.flatnonzero(differs)
        previous = suffixes[heads[np.cumsum(differs) - 1]]
        marked = suffixes[owners[previous] < owners[suffixes]]
        spans.append((owners[marked], at[marked], at[marked] + 1))
    owners, begins, ends = _merged(*map(np.concatenate, zip(*spans)))
    return pa.table({"doc": owners, "begin": begins, "end": ends + (length - 1)})


def _merged(docs: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join what touches or overlaps."""
    if not len(docs):
        return docs, begins, ends
    order = np.lexsort((begins, docs))
    docs, begins, ends = docs[order], begins[order], ends[order]
    fresh = np.ones(len(docs), bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (begins[1:] > ends[:-1])
    first = np.flatnonzero(fresh)
    return docs[first], begins[first], np.maximum.reduceat(ends, first)


#: What is packed of each run beside its bytes. A count below 0 says that the run is a repeat, and that no bytes follow.
PACKED = ("docs", "starts", "counts", "keys")


def _run_bytes(
    hot: np.ndarray, buckets: int, length: int, batch: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From documents with their shared runs: the runs' bytes, equal runs of a batch once, hot anchors by windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in gathered(batches, 2, SLICE):
            held.append(_cut_runs(part, hot, length))
            size += len(held[-1][0])
            if size >= batch:
                yield _packed_runs(held, buckets, length)
                held, size = [], 0
        if size:
            yield _packed_runs(held, buckets, length)
        held.clear()
        give_back()

    return work


def _cut_runs(part: pa.RecordBatch, hot: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Document, start, number of windows, anchor, content hash and bytes of each run of a batch of documents."""
    offsets, data = flat(part.column(2))
    lists = part.column(3)
    runs = lists.flatten()
    own = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
    starts, tails = runs.field("start").to_numpy(), runs.field("tail").to_numpy()
    mine = starts // PART == part.column(1).to_numpy()[own]
    own, starts, tails = own[mine], starts[mine], tails[mine]
    counts, keys = tails & 0xFFFF, tails >> 16
    docs = part.column(0).to_numpy()[own]
    places = offsets[own] + starts % PART
    split = np.isin(keys, hot) if len(hot) else np.zeros(len(keys), bool)
    if split.any():
        number = counts[split]
        within = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        docs = np.concatenate([docs[~split], np.repeat(docs[split], number)])
        keys = np.concatenate([keys[~split], np.full(len(within), -1)])
        starts, places = (
            np.concatenate([c[~split], np.repeat(c[split], number) + within]) for c in (starts, places)
        )
        counts = np.concatenate([counts[~split], np.ones(len(within), np.int64)])
    codes = span_hashes(BYTE_CODES[data], places, places + counts + length - 1)
    keys = np.where(keys < 0, codes.view(np.int64), keys)
    sizes = counts + length - 1
    ends = np.cumsum(sizes)
    text = data[np.repeat(places - (ends - sizes), sizes) + np.arange(ends[-1])] if len(ends) else data[:0]
    return docs, starts, counts, keys, codes, text


def _spread(places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of stretches that begin at ``places``, one stretch after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(places - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _later_copies(
    docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray, codes: np.ndarray, text: np.ndarray,
) -> np.ndarray:
    """Which runs an earlier document among them has byte for byte; equal ``codes`` only say where to look."""
    order = np.lexsort((starts, docs, sizes, codes))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (codes[order[1:]] != codes[order[:-1]]) | (sizes[order[1:]] != sizes[order[:-1]])
    leader = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(order) else order
    later = docs[leader] < docs[order]
    run, leader = order[later], leader[later]
    repeat = np.zeros(len(docs), bool)
    for at in range(0, len(run), 16_384):
        part = slice(at, at + 16_384)
        own = sizes[run[part]]
        differs = text[_spread(places[run[part]], own)] != text[_spread(places[leader[part]], own)]
        repeat[run[part]] = np.add.reduceat(differs, np.cumsum(own) - own, dtype=np.int64) == 0
    return repeat


def _packed_runs(held: list[tuple[np.ndarray, ...]], buckets: int, length: int) -> pa.RecordBatch:
    docs, starts, counts, keys, codes, text = map(np.concatenate, zip(*held))
    sizes = counts + length - 1
    places = np.cumsum(sizes) - sizes
    # Of equal runs only the earliest document's go on; the others are repeats whatever else there is.
    repeat = _later_copies(docs, starts, sizes, places, codes, text)
    counts, sizes = np.where(repeat, -counts, counts), np.where(repeat, 0, sizes)
    # Repeats need no company: they are dealt by their document.
    dealt = np.where(repeat, mixed(docs.view(np.uint64)), mixed(keys.view(np.uint64)))
    bucket = (dealt >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    rows = []
    for number, a, b in _pieces(bucket[order]):
        own = order[a:b]
        packs = [packed(c[own], "<i8") for c in (docs, starts, counts, keys)]
        rows.append((number, *packs, squeezed(text[_spread(places[own], sizes[own])].tobytes())))
    names = ["bucket", *PACKED, "text"]
    return pa.record_batch(
        [pa.array(c, pa.int64() if n == "bucket" else pa.binary()) for n, c in zip(names, zip(*rows))], names
    )


# The whole


def numbered_parts(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """``doc, part, text``: rows that share an id are parts of one document; a null id counts as the largest there can be. And
    the columns that runs and spans are dealt by: where no id repeats, ``doc`` tells rows apart."""
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))
    if rows.groupBy("doc").count().where(F.col("count") > 1).isEmpty():
        return rows.select("doc_id", "doc", F.lit(0).alias("part"), "text", "row"), ["doc"]
    # A document's rows are numbered within slots by their text, after the rows of the slots before.
    slotted = rows.withColumn("__slot", F.pmod(F.xxhash64("text"), F.lit(SLOTS)))
    before = Window.partitionBy("doc").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slotted.groupBy("doc", "__slot").count().select(
        "doc", "__slot", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before")
    )
    order = Window.partitionBy("doc", "__slot").orderBy(F.xxhash64("text"), "text")
    part = (F.row_number().over(order) - 1 + F.col("__before")).cast("int")
    return slotted.join(slots, ["doc", "__slot"]).select("doc_id", "doc", part.alias("part"), "text", "row"), ["doc", "part"]


def _copies(parts: DataFrame) -> DataFrame:
    """``doc, part, size`` of whole texts that an earlier document has: they go without looking for anchors."""
    spark = parts.sparkSession
    digests = parts.select("doc", "part", F.octet_length("text").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    first = digests.groupBy("sha").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    folder = new_folder(spark, "copies")
    digests.join(first.where(F.col("first") < F.col("last")), "sha").where(F.col("doc") > F.col("first")).select(
        "doc", "part", "size"
    ).write.parquet(folder)
    copies = spark.read.schema("doc long, part int, size int").parquet(folder)
    return F.broadcast(copies) if copies.count() <= FEW else copies


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, hot_runs: int = HOT,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Every row with its text and the spans of it to remove: ``doc_id, part, text, spans`` (array of begin, end), and
    with the columns that ``keep`` names in one column ``row``.

    Offsets are bytes of the UTF-8 text; spans may overlap and are in no order. Null text is empty and has none. Rows
    that share an id are parts of one document and don't remove each other's bytes; a null id counts as 2^63 - 1.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.struct(*[F.col(name) for name in keep]).alias("row"),
    )
    numbered, keys = numbered_parts(rows)
    parts = numbered.drop("row")
    copies = _copies(parts)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(1 + total // (18 * bucket))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(buckets, 2 * shuffles)
    folder = new_folder(spark, "runs")
    (
        parts.join(copies.select("doc", "part"), ["doc", "part"], "left_anti")
        .select("doc", "part", F.col("text").cast("binary").alias("text"))
        # A fixed order: what is known to be shared within a batch must come out the same when a lost task runs again.
        .sortWithinPartitions("doc", "part")
        .mapInArrow(_anchor_rows(buckets, length, bucket),
                    "bucket long, keys binary, docs binary, starts binary, counts binary, sizes binary")
        .groupBy("bucket").applyInArrow(_shared_runs(buckets, hot_runs), "doc long, start long, tail long")
        .write.parquet(folder)
    )
    found = spark.read.schema("doc long, start long, tail long").parquet(folder)
    # At most HOT_KEYS anchors have more than their share, so this stays small at any size.
    marks, runs = found.where(F.col("doc").isNull()), found.where(F.col("doc").isNotNull())
    share = max(hot_runs, runs.count() // HOT_KEYS)
    hot = np.array([r["tail"] >> 16 for r in marks.where(F.col("start") > share).select("tail").collect()], np.int64)
    listed = runs.withColumn("part", F.expr(f"CAST(start DIV {PART} AS INT)")).groupBy(*keys).agg(
        F.collect_list(F.struct("start", "tail")).alias("runs")
    )
    spans = (
        parts.join(listed.hint("shuffle_hash"), keys)
        .select("doc", "part", F.col("text").cast("binary").alias("text"), "runs")
        # A fixed order here too: equal runs are collapsed within a batch.
        .sortWithinPartitions("doc", "part")
        .mapInArrow(_run_bytes(hot, buckets, length, bucket // 2),
                    "bucket long, docs binary, starts binary, counts binary, keys binary, text binary")
        .groupBy("bucket").applyInArrow(lambda table: _earlier(table, length), "doc long, begin long, end long")
    )
    whole = copies.where(F.col("size") >= length).select(
        "doc", (F.col("part") * PART).alias("begin"), (F.col("part") * PART + F.col("size")).alias("end")
    )
    spans = spans.unionByName(whole).withColumn("part", F.expr(f"CAST(begin DIV {PART} AS INT)")).groupBy(*keys).agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    if not keep:
        return parts.join(spans.hint("shuffle_hash"), keys, "left").select("doc_id", "part", "text", "spans")
    # The other columns come in with the spans: texts, dealt by document for the runs already, aren't moved once more.
    others = numbered.select(*keys, "row").join(spans.hint("shuffle_hash"), keys, "left")
    return parts.join(others.hint("shuffle_hash"), keys).select("doc_id", "part", "text", "spans", "row")


def kept_bytes(size: int, spans: pa.StructArray | None, part: int) -> np.ndarray:
    """Mask of the bytes that stay."""
    steps = np.zeros(size + 1, np.int64)
    if spans is not None and len(spans):
        begins, ends = (spans.field(i).to_numpy() for i in (0, 1))
        own = begins // PART == part
        np.add.at(steps, begins[own] % PART, 1)
        np.add.at(steps, begins[own] % PART + (ends - begins)[own], -1)
    return np.cumsum(steps[:-1]) == 0


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET,
    hot_runs: int = HOT,
) -> DataFrame:
    """One row for each row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept``, the bytes that stay.

    See ``repeated_spans`` for nulls and repeated ids; an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            names, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, (name, part) in enumerate(zip(names, numbers)):
                data = np.frombuffer(batch.column(2)[row].as_buffer(), np.uint8)
                stays = kept_bytes(len(data), batch.column(3)[row].values, part)
                gone = ~stays
                spans = int(gone[:1].sum()) + int((gone[1:] & stays[:-1]).sum())
                kept = data[stays].tobytes()
                rows.append((name, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, types)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    found = repeated_spans(docs, length, id_col, text_col, bucket, hot_runs)
    rows = found.select("doc_id", "part", F.col("text").cast("binary").alias("text"), "spans")
    return rows.mapInArrow(
        work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )


def without_repeats(
    docs: DataFrame, keep: tuple[str, ...], length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Every row's text without its repeats, ``text``, and the columns that ``keep`` names in one column ``row``.

    A character goes if any of its bytes does, so what stays is text. A text of which nothing stays is empty.
    """
    types = dict(docs.select(F.struct(*[F.col(name) for name in keep]).alias("row")).dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for row, part in enumerate(batch.column(0).to_pylist()):
                data = np.frombuffer(batch.column(1)[row].as_buffer(), np.uint8)
                stays = kept_bytes(len(data), batch.column(2)[row].values, part)
                begins = np.flatnonzero(data & 0xC0 != 0x80)
                if len(begins):
                    whole = np.logical_and.reduceat(stays, begins)
                    stays = np.repeat(whole, np.diff(np.append(begins, len(data))))
                texts.append(data[stays].tobytes().decode())
            yield pa.record_batch([pa.array(texts, pa.string()), batch.column(3)], ["text", "row"])

    found = repeated_spans(docs, length, id_col, text_col, keep=keep)
    rows = found.select("part", F.col("text").cast("binary").alias("text"), "spans", "row")
    return rows.mapInArrow(work, f"text string, row {types['row']}")


@query()
def op2_suffix_dedup(spark, folder):
    """What is left of every document without the passages that an earlier one has."""
    return remove_repeats(read(spark, folder, "documents")).drop("kept")
