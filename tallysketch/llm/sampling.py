"""Labelled rows to fit a classifier on: a bounded number for each label, the same ones on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Most bytes of text that are fitted on, by label.
BYTES = 256 << 20


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: dict[int, int],
    id_col: str = "doc_id", text_col: str = "text", size: int = BYTES,
) -> DataFrame:
    """Columns ``text, label``: for each label value at most ``most[value]`` rows of ``docs``, lowest hashes of the id
    first, up to the one that brings their texts to ``size`` bytes.

    Only ids for which ``learn`` (an expression over ``__id``) holds are taken; rows without id or label are not.
    An id with several labels counts with the largest, and one with several rows brings each. The ids are bounded by
    ``most``, so they are broadcast; the rows they bring are bounded again.
    """
    known = (
        labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__label"))
        .where(F.col("__id").isNotNull() & F.col("__label").isin(*most) & learn)
        .groupBy("__id").agg(F.max("__label").alias("__label"))
    )
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    order = [F.xxhash64("__id"), F.col("__id"), F.xxhash64("__text"), F.col("__text")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # over at most ``bound`` rows
    picked = None
    for value, bound in most.items():
        ids = known.where(F.col("__label") == value).orderBy(F.xxhash64("__id"), "__id").limit(bound)
        rows = texts.join(F.broadcast(ids), "__id").orderBy(*order).limit(bound)
        held = F.coalesce(F.sum(F.coalesce(F.octet_length("__text"), F.lit(0))).over(before), F.lit(0))
        part = rows.withColumn("__held", held).where(F.col("__held") < size)
        picked = part if picked is None else picked.unionByName(part)
    return picked.select(F.col("__text").alias("text"), F.col("__label").alias("label"))


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids stand in the class of the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus
