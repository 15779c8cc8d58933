"""Near duplicates by MinHash: banded candidates, sequential Bayesian verification, exact confirmation.

Documents with one and the same shingle set are a class from the start, and only one of them goes on, as a node with a number
of its own: an id that repeats with different texts is in as many classes, which are linked by it. Signatures are
cut into bands; a bucket holds the classes that agree in a band. Links are looked for in three rounds, each of which
leaves out what is connected already: each class with one smallest member of its buckets, with one pivot picked by a
bucket's key, and between all members that are still in different components, block by block. A candidate's signatures are compared a
batch of hashes at a time, and it is dropped as soon as the posterior probability of the wanted similarity (uniform
prior) falls below ``MISS``. Survivors are confirmed on the full sets. So a group of near copies costs links to a few
members, not all its pairs, and components are exactly those of the links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import new_folder
from .catalog import query, read
from .components import stars
from .text import flat, give_back, mixed, slices, word_bounds, word_hashes, worker_table

SHINGLE = 5
ROWS = 4
#: Probability that a pair of the wanted similarity shares no band, and posterior below which a candidate is dropped.
MISS = 1e-6
BATCH = 16
SLICE = 2 << 20
#: Members of a bucket that are compared in one task.
BLOCK = 1024
#: Columns of a bucket's members.
MEMBER = ["key", "one", "other", "node", "root", "block", "band", "signature"]
#: Ids that may be broadcast; more are joined by a shuffle.
FEW = 1_000_000


def bands_for(percent: int) -> int:
    """Bands after which a pair of the wanted similarity is missed with probability ``MISS`` at most."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def shingle_sets(offsets: np.ndarray, data: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingles (64-bit hashes) of each text; of fewer than ``size`` words, one for them all."""
    starts, ends, owner = word_bounds(offsets, data)
    words = word_hashes(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
    cuts = np.searchsorted(owner, np.arange(len(offsets))).tolist()
    factors = mixed(np.arange(1, size + 2, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
    whole = max(0, len(words) - size + 1)
    sums = np.zeros(whole, np.uint64)
    for place in range(size):
        sums += words[place:place + whole] * factors[place]
    sums = mixed(sums)
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a >= size:
            yield np.unique(sums[a:b - size + 1])
        elif b > a:
            count = factors[size:] * np.uint64(b - a)
            yield mixed((words[a:b] * factors[:b - a]).sum(keepdims=True) + count)
        else:
            yield np.empty(0, np.uint64)


def _set_key(shingles: np.ndarray) -> bytes | None:
    """Digest of a set; the empty set has none."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signature(shingles: np.ndarray, hashes: int) -> np.ndarray:
    """Smallest value of each hash function over a set, 32 bits each."""
    factors = mixed(np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) | np.uint64(1)
    shifts = mixed(np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    least = np.full(hashes, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 2048):
        part = shingles[at:at + 2048]
        least = np.minimum(least, (part[None, :] * factors[:, None] + shifts[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype("<u4")


def least_matches(percent: int, hashes: int, miss: float = MISS) -> list[tuple[int, int]]:
    """After so many hashes, the fewest matches with which a candidate goes on.

    With a uniform prior, P(similarity >= s | m of n match) is the chance of at most m successes in n + 1 trials of
    probability s.
    """
    s, out = percent / 100, []
    for n in [*range(BATCH, hashes, BATCH), hashes]:
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * s ** m * (1 - s) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def _signatures(hashes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_table(None)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                sizes, keys, held = [], [], []
                for own in shingle_sets(*flat(part.column(1))):
                    sizes.append(len(own))
                    keys.append(_set_key(own))
                    held.append(signature(own, hashes).tobytes() if len(own) else None)
                yield pa.record_batch(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(held, pa.binary())],
                    ["doc_id", "n_shingles", "set_key", "signature"],
                )
        give_back()

    return work


def _band_keys(hashes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    bands = hashes // ROWS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _matrix(batch.column(1), hashes).reshape(-1, bands, ROWS).astype(np.uint64)
            keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), values.shape[:2])
            for place in range(ROWS):
                keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, :, place])
            yield pa.record_batch(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), bands)),
                 pa.array(np.tile(np.arange(bands, dtype=np.int32), len(values)))],
                ["key", "node", "band"],
            )

    return work


def _matrix(column: pa.Array, hashes: int) -> np.ndarray:
    return flat(column)[1].view("<u4").reshape(-1, hashes)


def _likely(percent: int, hashes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs that survive the sequential test."""
    steps = least_matches(percent, hashes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = _matrix(batch.column(2), hashes), _matrix(batch.column(3), hashes)
            alive, matches, begin = np.arange(len(left)), np.zeros(len(left), np.int64), 0
            for end, least in steps:
                matches[alive] += (left[alive, begin:end] == right[alive, begin:end]).sum(axis=1)
                alive, begin = alive[matches[alive] >= least], end
            yield pa.RecordBatch.from_arrays([c.take(pa.array(alive)) for c in batch.columns[:2]], ["a", "b"])

    return work


def _open_pairs(table: pa.Table, percent: int, hashes: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of a block or two of a bucket, sorted by node: for each row the later ones in other components that survive the
    sequential test. A pair is looked at in the first band it shares only."""
    steps = least_matches(percent, hashes)
    roots, blocks, band = table["root"].to_numpy(), table["block"].to_numpy(), table["band"][0].as_py()
    values = _matrix(table["signature"].combine_chunks(), hashes)
    two = table["one"][0].as_py() != table["other"][0].as_py()
    for row in range(len(roots) - 1):
        alive = np.arange(row + 1, len(roots))
        alive = alive[(roots[alive] != roots[row]) & ((blocks[alive] != blocks[row]) | (not two))]
        matches, begin = np.zeros(len(alive), np.int64), 0
        for end, least in steps:
            if not len(alive):
                break
            matches += (values[alive, begin:end] == values[row, begin:end]).sum(axis=1)
            stay = matches >= least
            alive, matches, begin = alive[stay], matches[stay], end
        if band and len(alive):
            before = (values[alive, :ROWS * band] == values[row, :ROWS * band]).reshape(len(alive), band, ROWS)
            alive = alive[~before.all(axis=2).any(axis=1)]
        if len(alive):
            yield row, alive


def _contenders(percent: int, hashes: int) -> Callable[[pa.Table], pa.Table]:
    """Members of a block or two that survive the sequential test with any other."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        needed = np.zeros(table.num_rows, bool)
        for row, alive in _open_pairs(table, percent, hashes):
            needed[row] = needed[alive] = True
        return table.filter(pa.array(needed)).select(MEMBER)

    return work


def _across(percent: int, hashes: int) -> Callable[[pa.Table], pa.Table]:
    """Links between components within a block or two, confirmed on the full sets; components are joined on the way, so
    there are fewer links than members."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        nodes, roots = table["node"].to_numpy(), table["root"].to_numpy()
        ends, data = flat(table["shingles"].combine_chunks())
        data, ends = data.view("<u8"), ends // 8
        joined = {root: root for root in np.unique(roots).tolist()}

        def find(root: int) -> int:
            while joined[root] != root:
                joined[root] = root = joined[joined[root]]
            return root

        left, right = [], []
        for row, alive in _open_pairs(table, percent, hashes):
            own = data[ends[row]:ends[row + 1]]
            for other in alive.tolist():
                a, b = find(roots[row].item()), find(roots[other].item())
                theirs = data[ends[other]:ends[other + 1]]
                if a == b or 100 * min(len(own), len(theirs)) < percent * max(len(own), len(theirs)):
                    continue
                place = np.searchsorted(own, theirs)
                both = int((own[np.minimum(place, len(own) - 1)] == theirs).sum())
                if 100 * both >= percent * (len(own) + len(theirs) - both):
                    joined[max(a, b)] = min(a, b)
                    left.append(nodes[row])
                    right.append(nodes[other])
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return work


def _confirmed(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for row in range(batch.num_rows):
                left, right = (np.frombuffer(batch.column(c)[row].as_buffer(), "<u8") for c in (2, 3))
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= percent * (len(left) + len(right) - both):
                    good.append(row)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(good, pa.int64())) for c in batch.columns[:2]], ["a", "b"])

    return work


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 0, SLICE):
            sets = list(shingle_sets(*flat(part.column(0))))
            yield pa.record_batch(
                [pa.array([_set_key(own) for own in sets], pa.binary()),
                 pa.array([own.astype("<u8").tobytes() for own in sets], pa.binary())], ["set_key", "shingles"])
    give_back()


class _Rounds:
    """The rounds of a search: candidates in, links and components out."""

    def __init__(self, rows: DataFrame, percent: int) -> None:
        self.spark, self.percent = rows.sparkSession, percent
        self.hashes = ROWS * bands_for(percent)
        self.signed = self.stored(
            rows.mapInArrow(_signatures(self.hashes), "doc_id long, n_shingles long, set_key binary, signature binary"),
            "signatures",
        )
        linked = self.signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
        # Numbered as they are written: the stored numbers are what all later steps read.
        self.classes = self.stored(
            linked.groupBy("set_key").agg(F.min(F.struct("doc_id", "signature")).alias("first")).select(
                "set_key", F.monotonically_increasing_id().alias("node"), F.col("first.doc_id").alias("least_id"),
                F.col("first.signature").alias("signature")), "classes",
        )
        keys = self.classes.select("node", "signature").mapInArrow(_band_keys(self.hashes), "key long, node long, band int").distinct()
        entries = self.stored(keys, "bands")
        # The pivot is a member picked by the bucket's key: exclusive or with it orders members anew in each bucket.
        many = entries.groupBy("key").agg(
            F.count(F.lit(1)).alias("size"), F.min("node").alias("least"),
            F.min(F.col("node").bitwiseXOR(F.col("key"))).bitwiseXOR(F.col("key")).alias("pivot"),
        ).where(F.col("size") > 1)
        self.entries = self.stored(entries.join(many, "key"), "buckets")
        self.sets = self.stored(self._sets(rows), "sets")
        self.roots = self.spark.createDataFrame([], "node long, root long")
        repeated = self.stored(linked.groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id"), "repeated-ids")
        if not repeated.isEmpty():
            self.link(self._same_ids(linked, repeated))

    def stored(self, frame: DataFrame, purpose: str) -> DataFrame:
        """Written to the shared folder, so that later steps don't compute it again, also after an executor is lost."""
        folder = new_folder(self.spark, purpose)
        frame.write.parquet(folder)
        return self.spark.read.schema(frame.schema).parquet(folder)

    def _sets(self, rows: DataFrame) -> DataFrame:
        """Full shingle sets of the classes that share a bucket with another, ``node, shingles``."""
        shared = self.entries.select("node").distinct()
        wanted = self.stored(self.classes.select("node", "set_key", "least_id").join(shared, "node", "left_semi"), "wanted")
        few = wanted.count() <= FEW
        ids = wanted.select(F.col("least_id").alias("doc_id")).distinct()
        found = rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("text").mapInArrow(
            _set_rows, "set_key binary, shingles binary")
        nodes = wanted.select("set_key", "node")
        # Several rows of one id may bring one set.
        return found.join(F.broadcast(nodes) if few else nodes, "set_key").select("node", "shingles").dropDuplicates(["node"])

    def _same_ids(self, linked: DataFrame, repeated: DataFrame) -> DataFrame:
        """Links between the classes that rows of one id are in."""
        members = linked.join(repeated, "doc_id", "left_semi").select("doc_id", "set_key").join(
            self.classes.select("set_key", "node"), "set_key").select("doc_id", "node").distinct()
        first = members.groupBy("doc_id").agg(F.min("node").alias("b"))
        return members.join(first, "doc_id").select(F.col("node").alias("a"), "b").where("a != b")

    def rooted(self) -> DataFrame:
        """Bucket entries with the component each is in so far."""
        return self.entries.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def with_star(self, hub: str) -> DataFrame:
        """Candidates: each class with one member of its buckets, the one it shares most bands with among those in other
        components."""
        pairs = (
            self.entries.where(F.col("node") != F.col(hub)).groupBy("node", F.col(hub).alias("hub"))
            .agg(F.count(F.lit(1)).alias("shared"))
        )
        left = self.roots.select(F.col("node"), F.col("root").alias("__left"))
        right = self.roots.select(F.col("node").alias("hub"), F.col("root").alias("__right"))
        apart = pairs.join(left, "node", "left").join(right, "hub", "left").where(
            F.coalesce("__left", "node") != F.coalesce("__right", "hub")
        )
        best = apart.groupBy("node").agg(F.max(F.struct("shared", F.bitwise_not("hub").alias("hub"))).alias("best"))
        best = best.select("node", F.bitwise_not("best.hub").alias("hub"))
        pairs = best.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        signed = self.classes.select("node", "signature")
        return (
            pairs.join(signed.select(F.col("node").alias("a"), F.col("signature").alias("left")), "a")
            .join(signed.select(F.col("node").alias("b"), F.col("signature").alias("right")), "b")
            .select("a", "b", "left", "right").mapInArrow(_likely(self.percent, self.hashes), "a long, b long")
        )

    def between_components(self) -> DataFrame:
        """Links between members of a bucket in different components, found within blocks and pairs of blocks.

        Full sets go only to blocks in which a member has survived the sequential test, and are compared there.
        """
        rooted = self.stored(self.rooted(), "rooted")
        open_keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(
            F.col("low") != F.col("high")
        )
        signed = self.classes.select("node", "signature")
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        members = (
            rooted.join(open_keys.select("key"), "key", "left_semi").join(signed, "node")
            .withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("one", F.least("block", "with")).withColumn("other", F.greatest("block", "with"))
            .select(*MEMBER)
        )
        schema = "key long, one int, other int, node long, root long, block int, band int, signature binary"
        contenders = self.stored(
            members.groupBy("key", "one", "other").applyInArrow(_contenders(self.percent, self.hashes), schema), "contenders"
        )
        return contenders.join(self.sets, "node").groupBy("key", "one", "other").applyInArrow(
            _across(self.percent, self.hashes), "a long, b long"
        )

    def confirm(self, candidates: DataFrame) -> None:
        """Check candidates on the full sets and join what they link."""
        pairs = self.stored(candidates, "candidates")
        if pairs.isEmpty():
            return
        sets = self.sets
        self.link(
            pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
            .select("a", "b", "left", "right").mapInArrow(_confirmed(self.percent), "a long, b long")
        )

    def link(self, links: DataFrame) -> None:
        self.roots = stars(links.unionByName(self.roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, n_shingles, component_id, kept. Links need ``100 * both >= percent * either``.

    Null and empty texts and texts without words have no shingles and no links. Rows that share an id are linked with
    each other, and each by its own text with others; rows without id are linked to nothing, have a null component and
    are kept. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rounds = _Rounds(rows, percent)
    rounds.confirm(rounds.with_star("least"))
    rounds.confirm(rounds.with_star("pivot"))
    rounds.link(rounds.between_components())
    rooted = rounds.classes.select("set_key", "node", "least_id").join(rounds.roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = rooted.join(least, "root").select("set_key", "component_id")
    found = rounds.signed.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        (F.col("doc_id").eqNullSafe(component)).alias("kept"),
    )


@query()
def op3_minhash(spark, folder):
    """Groups of near copies among all documents."""
    return near_duplicates(read(spark, folder, "documents"), 85)
