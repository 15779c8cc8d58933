"""Centroid clustering in exact integers, where each cluster keeps its vectors in the order of their bound gaps.

A vector's gap is the distance to the second nearest centroid less that to its own. When centroids move, the gap shrinks by
no more than the drift of its own centroid and the largest drift of the others, so a cluster only adds up that drift: a
vector stored with ``expires`` = gap + drift at that time is rescanned once the cluster's drift exceeds it. Those are the
tops of the cluster's heap.

The heaps are tables. Each generation is written in order of cluster and ``expires``, so that the file statistics let a
scan skip what has not expired: a round reads the stretch between the drift before and the drift now from all generations,
rescans these vectors against all centroids and writes them as the next generation. What a round has popped lies below the
drift of that round for good, so no row is ever rewritten or marked. Sums of the clusters follow the moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import new_folder
from .catalog import query, read

#: Components after scaling; beyond this a squared distance might not fit 64 bits, and the component counts as this much.
LIMIT = 1 << 27
#: A gap counts as used up this much earlier, relative to the distances: bounds are doubles, distances exact integers.
SLACK = 1e-9
#: Vectors whose distances are computed at once.
SLICE = 8192
SCALE = 1024


def usable(vectors: DataFrame, width: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector``: vectors of exactly ``width`` components, none null or not finite, as integers."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform("vector", lambda x: F.greatest(
        F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(x * SCALE).cast("double"))).cast("int"))
    return vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")
    ).where((F.size("vector") == width) & finite).select("vec_id", scaled.alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row for each vector."""
    largest = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * largest * largest * vectors.shape[1] < 2 ** 53:  # then every sum of doubles is an exact integer
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v ** 2).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c ** 2).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _gaps(squares: np.ndarray, nearest: np.ndarray) -> np.ndarray:
    """Distance to the second nearest less that to the nearest, a little less for rounding, and not below 0."""
    rows = np.arange(len(squares))
    upper = np.sqrt(squares[rows, nearest].astype(np.float64))
    others = squares.astype(np.float64)
    others[rows, nearest] = np.inf
    lower = np.sqrt(others.min(axis=1))
    return np.where(np.isinf(lower), lower, np.maximum(lower - upper - SLACK * (1 + lower + upper), 0))


class Clusters:
    """What the driver keeps: k centroids of fixed width, their sums and counts, and the drift of each heap."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.sums = [[0] * centroids.shape[1] for _ in centroids]
        self.counts = [0] * len(centroids)
        self.drift = [0.0] * len(centroids)

    def move(self) -> None:
        """Put each non-empty centroid at the floor of its mean, and add to the drifts what bounds may have lost."""
        old = self.centroids
        self.centroids = np.array([
            [total // count for total in sums] if count else own.tolist()
            for sums, count, own in zip(self.sums, self.counts, old)
        ], np.int64)
        moved = np.sqrt(((self.centroids - old).astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK)
        for number in range(len(moved)):
            others = np.delete(moved, number)
            self.drift[number] += float(moved[number] + others.max(initial=0.0))


GENERATION = "vec_id long, vector array<int>, was int, cluster int, expires double"


def _rescanned(rows: DataFrame, clusters: Clusters) -> DataFrame:
    """Each vector's nearest centroid among all, ties to the smaller number, and when that has to be looked at again."""
    centroids, drift = clusters.centroids, np.array(clusters.drift)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                squares = squared_distances(_matrix(part.column("vector")), centroids)
                nearest = squares.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id"), part.column("vector"), part.column("was"), pa.array(nearest.astype(np.int32)),
                    pa.array(_gaps(squares, nearest) + drift[nearest]),
                ], ["vec_id", "vector", "was", "cluster", "expires"])

    return rows.mapInArrow(work, GENERATION).sortWithinPartitions("cluster", "expires")


def _changes(generation: DataFrame, k: int, width: int) -> tuple[list[list[int]], list[int]]:
    """What the vectors of a generation add to the sums and counts of their new clusters and take from those before."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            vectors = _matrix(batch.column("vector"))
            for name, sign in (("cluster", 1), ("was", -1)):
                numbers = batch.column(name).to_numpy()
                for number in range(k):
                    own = numbers == number
                    sums[number] += sign * vectors[own].sum(axis=0)
                    counts[number] += sign * int(own.sum())
            # A task's own sums stay below 2^63 up to 2^36 vectors.
        yield pa.record_batch([
            pa.array(range(k), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.int64())), pa.array(counts),
        ], ["number", "sums", "counts"])

    moved = generation.where("was != cluster").select("vector", "was", "cluster")
    parts = moved.mapInArrow(work, "number int, sums array<long>, counts long")
    counted = parts.groupBy("number").agg(F.sum("counts").alias("n")).collect()
    added = parts.select("number", F.posexplode("sums").alias("place", "part")).groupBy("number", "place").agg(
        F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    totals, counts = [[0] * width for _ in range(k)], [0] * k
    for row in counted:
        counts[row.number] = row.n
    for row in added:
        totals[row.number][row.place] = int(row.total)
    return totals, counts


def _within(cluster: Column, expires: Column, low: list[float], high: list[float] | None) -> Column:
    """Rows of the heaps from ``low`` on, and below ``high``, as plain comparisons that reach the files' statistics."""
    out = F.lit(False)
    for number, begin in enumerate(low):
        own = (cluster == number) & (expires >= begin)
        out = out | (own if high is None else own & (expires < high[number]))
    return out


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, seed: int = 3,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector that takes part.

    Vectors of ``width`` components, none null or not finite, take part, each component x as floor(1024 * x), no further
    from 0 than 2^27. Centroids start as the k vectors with the smallest SHA-256 of ``seed:vec_id``, equal ones in the
    order of their components, null ids last; with fewer vectors there are fewer clusters. After ``rounds`` rounds vectors are
    assigned once more. Ids are not looked at otherwise: rows that repeat count and return each. ``distance`` is squared,
    ``cluster_inertia`` and ``inertia`` are its sums (no more than 2^63 - 1 is reported). Empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, width, id_col, vector_col)
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    begin = rows.withColumn("name", named).orderBy(F.asc_nulls_last("name"), "vector").limit(k).collect()
    if not begin:
        return spark.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state = Clusters(np.array([row.vector for row in begin], np.int64))
    k = len(begin)

    folder = new_folder(spark, "heaps")
    popped = rows.withColumn("was", F.lit(-1))
    low = list(state.drift)
    for turn in range(rounds + 1):
        _rescanned(popped, state).write.parquet(f"{folder}/generation={turn}")
        fresh = spark.read.schema(GENERATION).parquet(f"{folder}/generation={turn}")
        if turn == rounds:
            break
        totals, counts = _changes(fresh, k, width)
        state.sums = [[a + b for a, b in zip(own, more)] for own, more in zip(state.sums, totals)]
        state.counts = [a + b for a, b in zip(state.counts, counts)]
        low = list(state.drift)
        state.move()
        heaps = spark.read.schema(GENERATION).parquet(*[f"{folder}/generation={n}" for n in range(turn + 1)])
        popped = heaps.where(_within(F.col("cluster"), F.col("expires"), low, state.drift)).withColumn("was", F.col("cluster"))
    heaps = spark.read.schema(GENERATION).parquet(*[f"{folder}/generation={n}" for n in range(rounds + 1)])
    live = heaps.where(_within(F.col("cluster"), F.col("expires"), state.drift, None))
    return _report(live, state)


def _report(live: DataFrame, state: Clusters) -> DataFrame:
    spark, centroids = live.sparkSession, state.centroids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = centroids[batch.column("cluster").to_numpy()]
            distance = ((_matrix(batch.column("vector")) - own) ** 2).sum(axis=1)
            yield pa.record_batch([batch.column("vec_id"), batch.column("cluster"), pa.array(distance)],
                                  ["vec_id", "cluster", "distance"])

    folder = new_folder(spark, "clusters")
    live.select("vec_id", "vector", "cluster").mapInArrow(work, "vec_id long, cluster int, distance long").write.parquet(folder)
    found = spark.read.parquet(folder)
    inertia = {row.cluster: int(row.total) for row in  # a row for each cluster
               found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    most = 2 ** 63 - 1
    whole = min(sum(inertia.values()), most)
    facts = spark.createDataFrame([
        (number, min(inertia.get(number, 0), most), whole,
         hashlib.sha256(",".join(map(str, centroids[number].tolist())).encode()).hexdigest())
        for number in range(len(centroids))
    ], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_in_sql(k: int, rounds: int, width: int) -> str:
    """The same clustering as plain table expressions: one row for each vector, centroid and round."""
    distance = "list_sum(list_transform(range(1, %d), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT" % (width + 1)
    parts = [f"""
kept AS MATERIALIZED (
    SELECT vec_id, row_number() OVER () AS place,
           list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width}
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS number, v AS c
    FROM kept QUALIFY number < {k}
)"""]
    for turn in range(rounds + 1):
        parts.append(f"""a{turn} AS MATERIALIZED (
    SELECT place, vec_id, v, min(struct_pack(distance := {distance}, number := number)) AS hit FROM kept, c{turn}
    GROUP BY place, vec_id, v
)""")
        if turn < rounds:
            parts.append(f"""c{turn + 1} AS MATERIALIZED (
    SELECT number, coalesce(m.c, old.c) AS c FROM c{turn} old LEFT JOIN (
        SELECT number, list(mean ORDER BY i) AS c FROM (
            SELECT number, i, (total - ((total % n) + n) % n) // n AS mean FROM (
                SELECT hit.number AS number, i, sum(v[i])::BIGINT AS total, count(*) AS n
                FROM a{turn}, (SELECT unnest(range(1, {width + 1})) AS i) GROUP BY ALL
            )
        ) GROUP BY number
    ) m USING (number)
)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, hit.number::INT AS cluster, hit.distance AS distance,
       (sum(hit.distance) OVER (PARTITION BY hit.number))::BIGINT AS cluster_inertia, (sum(hit.distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON number = hit.number"""


@query(_rounds_in_sql(8, 10, 64))
def op12_centroid_clustering(spark, folder):
    """Eight clusters of the embeddings after ten rounds."""
    return cluster(read(spark, folder, "embeddings"))
