"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue over all trees, exact rerank.

The splits of the trees are fitted on a bounded sample and sent to every task; every vector is then dealt to its leaf in
each tree, so the index covers all rows. A query walks all trees at once: one queue holds the branches not taken, the one
whose hyperplane is nearest first, until enough leaves are reached. Queries meet the vectors of their leaves by a join on
tree and leaf, where large leaves are cut into blocks, and each block returns its own nearest by exact distance. Vectors
that are equal bit for bit are indexed once, with the smallest ids that can ever be asked for.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import new_folder
from .catalog import query, read

#: Trees, sampled rows that a leaf is split down to, and most rows the splits are fitted on.
TREES, LEAF, SAMPLE = 8, 200, 20_000
#: Leaves that a query visits over all trees. On vectors without any structure this gives a recall of about 0.95 and
#: compares a query with half of them; vectors with structure do with far fewer.
VISITS = 120
#: Vectors of a leaf that are compared in one group.
BLOCK = 4096
SEED = 42


class Forest:
    """Random-projection trees as flat arrays: a node is a hyperplane with two children, or a leaf (child < 0)."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> None:
        random = np.random.default_rng(seed)
        #: Vectors are divided by this power of two, which keeps squares of very large and very small ones in range.
        self.unit = _unit(sample)
        sample = sample / self.unit
        self.normals: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.roots = [self._grow(sample, np.arange(len(sample)), leaf, random) for _ in range(trees)]
        width = sample.shape[1] if len(sample) else 0
        self.planes = np.array(self.normals, np.float64).reshape(len(self.normals), width)
        self.shifts = np.array(self.offsets)
        self.links = np.array(self.children, np.int64).reshape(-1, 2)

    def _grow(self, sample: np.ndarray, rows: np.ndarray, leaf: int, random: np.random.Generator) -> int:
        """Number of the node over ``rows``: -1 - number for a leaf. The split lies midway between two sampled vectors."""
        stack: list[tuple[np.ndarray, int, int]] = [(rows, -1, 0)]
        root = 0
        while stack:
            rows, parent, side = stack.pop()
            split = self._split(sample, rows, random) if len(rows) > leaf else None
            if split is None:
                number = -1 - self.leaves
                self.leaves += 1
            else:
                normal, offset, right = split
                number = len(self.normals)
                self.normals.append(normal)
                self.offsets.append(offset)
                self.children.append([0, 0])
                stack.append((rows[~right], number, 0))
                stack.append((rows[right], number, 1))
            if parent < 0:
                root = number
            else:
                self.children[parent][side] = number
        return root

    @staticmethod
    def _split(sample, rows, random):
        for _ in range(4):
            a, b = sample[random.choice(rows, 2, replace=False)]
            normal = b - a
            size = np.linalg.norm(normal)
            if not size:
                continue
            normal = normal / size
            offset = float(normal @ (a + b) / 2)
            right = sample[rows] @ normal > offset
            if right.any() and not right.all():
                return normal, offset, right
        return None

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        vectors = vectors / self.unit
        out = np.empty((len(vectors), len(self.roots)), np.int64)
        for tree, root in enumerate(self.roots):
            nodes = np.full(len(vectors), root)
            while len(at := np.flatnonzero(nodes >= 0)):
                here = nodes[at]
                right = np.einsum("ij,ij->i", vectors[at], self.planes[here]) > self.shifts[here]
                nodes[at] = self.links[here, right.astype(np.int64)]
            out[:, tree] = -1 - nodes
        return out

    def nearest_leaves(self, vector: np.ndarray, visits: int) -> list[int]:
        """Leaves in the order a queue shared by all trees gives them: the least margin crossed on the way comes first."""
        vector = vector / self.unit
        margins = self.planes @ vector - self.shifts if len(self.planes) else np.empty(0)
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        found: list[int] = []
        while queue and len(found) < visits:
            crossed, node = heapq.heappop(queue)
            while node >= 0:
                margin = margins[node]
                near, far = (1, 0) if margin > 0 else (0, 1)
                heapq.heappush(queue, (max(crossed, abs(margin)), self.links[node, far]))
                node = self.links[node, near]
            found.append(-1 - node)
        return found


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector`` without null, empty or zero vectors and those with a null or non-finite component."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return rows.where(F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0) & F.col("id").isNotNull())


def _stacked(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(*arrays: np.ndarray) -> float:
    """A power of two by which numbers can be divided so that their squares neither overflow nor vanish: 1 for usual ones."""
    largest = max((float(np.abs(a).max(initial=0.0)) for a in arrays), default=0.0)
    return 1.0 if largest == 0 or 1e-100 < largest < 1e100 else 2.0 ** min(max(int(np.frexp(largest)[1]), -1000), 1023)


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distance of each vector, also where a square leaves the range of doubles."""
    apart = vectors - query
    with np.errstate(over="ignore"):
        out = np.sqrt((apart ** 2).sum(axis=1))
    for row in np.flatnonzero(~((out > 1e-100) & (out < 1e150))).tolist():
        unit = _unit(apart[row])
        out[row] = np.sqrt(((apart[row] / unit) ** 2).sum()) * unit
    return out


def _nearest(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, ranks, scores = [], [], []
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            queries = _stacked(left["vector"].combine_chunks())
            vectors = _stacked(right["vector"].combine_chunks())
            unit = _unit(queries, vectors)
            given, queries, vectors, own = vectors, queries / unit, vectors / unit, queries
            names = right["id"].to_numpy()
            query_ids = left["query_id"].to_numpy()
            squares = (vectors ** 2).sum(axis=1)
            for at in range(0, len(queries), 256):
                part = queries[at:at + 256]
                rough = squares[None, :] - 2 * part @ vectors.T
                for row in range(len(part)):
                    close = np.arange(len(names))
                    if len(names) > 4 * k:
                        # The rough order may be off by rounding, so more than k are measured exactly.
                        close = np.argpartition(rough[row], 3 * k)[:3 * k]
                        limit = rough[row][close].max() + 1e-9 * (1 + squares.max())
                        close = np.flatnonzero(rough[row] <= limit)
                    exact = distances(given[close], own[at + row])
                    best = np.lexsort((names[close], exact))[:k + 1]
                    out[0].append(np.full(len(best), query_ids[at + row]))
                    out[1].append(names[close][best])
                    out[2].append(exact[best])
        ids, ranks, scores = (np.concatenate(c) if c else np.empty(0) for c in out)
        return pa.table({"query_id": ids.astype(np.int64), "id": ranks.astype(np.int64), "score": scores.astype(np.float64)})

    return work


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, visits: int = VISITS, block: int = BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the nearest vectors found, its own id left out.

    Scores are Euclidean distances on the original vectors in double precision; ties go to the smaller id. Vectors that
    are null, empty, zero or hold a null or non-finite component, and rows without id, take no part on either side, nor do
    vectors of another length than most (of the greater, if two are as frequent). An id that repeats stands for each of its vectors, and is reported once, with its
    smallest distance. Empty tables give no rows. Where all vectors fit into the leaves visited, the result is exact.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    kind = dict(rows.dtypes)["vector"]
    common = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = common["width"] if common else 0
    rows = rows.where(F.size("vector") == width)
    fitted = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()["vector"].combine_chunks()
    if isinstance(fitted, pa.ChunkedArray):
        fitted = pa.concat_arrays(fitted.chunks) if fitted.num_chunks else pa.array([], pa.list_(pa.float64()))
    sent = spark.sparkContext.broadcast(Forest(_stacked(fitted), trees, leaf))

    # Equal vectors are searched as one: only the k + 1 smallest ids can be among a query's k nearest.
    salted = Window.partitionBy("vector", "salt").orderBy("id")
    few = (
        rows.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
        .withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
        .withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("n") <= k + 1)
    )
    folder = new_folder(spark, "vectors")
    few.groupBy("vector").agg(F.min("id").alias("id"), F.collect_list("id").alias("same")).write.parquet(folder)
    distinct = spark.read.parquet(folder)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                found = forest.leaf_of(_stacked(part.column(1)))
                each = pa.array(np.repeat(np.arange(part.num_rows), found.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(each), part.column(1).take(each), pa.array(found.ravel())], ["id", "vector", "leaf"]
                )

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [forest.nearest_leaves(v, visits) for v in _stacked(part.column(1))]
                each = pa.array(np.repeat(np.arange(part.num_rows), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(each), part.column(1).take(each), pa.array(np.concatenate(found).astype(np.int64))],
                    ["query_id", "vector", "leaf"],
                )

    indexed = distinct.select("id", "vector").mapInArrow(leaves, f"id long, vector {kind}, leaf long")
    wanted = usable(queries, id_col, vector_col).where(F.size("vector") == width)
    asked = wanted.withColumn("vector", F.col("vector").cast(kind)).distinct().mapInArrow(
        visited, f"query_id long, vector {kind}, leaf long"
    )
    # A leaf is as many groups as it has blocks; a query goes to each of them.
    sizes = indexed.groupBy("leaf").agg((1 + F.floor(F.count(F.lit(1)) / block)).cast("int").alias("blocks"))
    folder = new_folder(spark, "leaves")
    sizes.write.parquet(folder)
    sizes = spark.read.parquet(folder)
    split = sizes.where(F.col("blocks") > 1)
    dealt = indexed.join(split, "leaf", "left").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int")
    )
    ways = split.select(F.col("leaf").alias("__leaf"), F.col("blocks").alias("__ways"))
    spread = asked.join(ways, F.col("leaf") == F.col("__leaf"), "left").select(
        "query_id", "vector", "leaf", F.explode(F.sequence(F.lit(0), F.coalesce("__ways", F.lit(1)) - 1)).alias("block")
    )
    near = spread.groupBy("leaf", "block").cogroup(dealt.groupBy("leaf", "block")).applyInArrow(
        _nearest(k), "query_id long, id long, score double"
    ).distinct()
    # Every equal vector's ids come back in; then the query's own goes.
    everyone = near.join(distinct.select("id", "same"), "id").select(
        "query_id", F.explode("same").alias("vec_id"), "score"
    ).where(F.col("vec_id") != F.col("query_id"))
    best = everyone.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


@query()
def op6_nearest_neighbours(spark, folder):
    """The ten nearest vectors of every hundredth."""
    vectors = read(spark, folder, "embeddings")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))
