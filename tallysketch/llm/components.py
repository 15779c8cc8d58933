"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import new_folder


def stars(links: DataFrame) -> DataFrame:
    """``node, root`` for every linked node but the roots: the root is the smallest node that can be reached.

    ``links`` has long columns ``a, b``. Each step hangs every node on the smallest node near it; links only ever shrink
    to stars, in a number of steps that grows with the logarithm of the size. Minima are taken before a shuffle, and the
    joins are on keys that may be hubs, which adaptive execution splits. Steps are written to the shared folder.
    """
    spark = links.sparkSession
    current = links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")
    ).distinct()
    before = None
    while True:
        folder = new_folder(spark, "stars")
        (current if before is None else _small(_large(current))).write.parquet(folder)
        current = spark.read.schema("node long, root long").parquet(folder)
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            return current
        before = tuple(state)


def _large(links: DataFrame) -> DataFrame:
    """Hang the larger neighbours of every node on the smallest node beside it or itself."""
    both = links.unionByName(links.select(F.col("root").alias("node"), F.col("node").alias("root")))
    least = both.groupBy("node").agg(F.min("root").alias("least"))
    return both.join(least, "node").where(F.col("root") > F.col("node")).select(
        F.col("root").alias("node"), F.least("least", "node").alias("root")
    ).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Hang every node and its smaller neighbours on the smallest of them."""
    least = links.groupBy("node").agg(F.min("root").alias("least"))
    moved = links.join(least, "node").where(F.col("root") != F.col("least")).select(
        F.col("root").alias("node"), F.col("least").alias("root")
    )
    return moved.unionByName(least.select("node", F.col("least").alias("root"))).distinct()
