"""Exact duplicates by content sort: range partitions of the normalised text, sorted, equal neighbours compared in full.

Plan: the sort key is a short prefix of the normalised text, a 64-bit content hash, and the text itself. Splitters are
sampled over the prefix and the hash only, so they stay small however long the texts are, and texts that merely begin
alike still spread. Within a partition the external sort puts equal texts side by side; the window over the full text
compares neighbours and finds each group. A text with very many copies is dealt over several ranges by a salt; the
ranges' best rows, at most one for each salt, are then compared once more over the full text. No Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import query, read

#: Characters deleted before texts are compared (fixed values).
WHITE_SPACE = " \t\n\v\f\r"
PREFIX = 32


def normalised(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for character in WHITE_SPACE:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and what ``keep`` names.

    Null text counts as empty. Of equal texts the longest original (code points) stays, then the smallest id; a null id
    comes after all others. Rows repeating an id and a text are members like others, and only one row of a group is
    kept. An empty table gives no rows. Other columns are not looked at; those that ``keep`` names are carried along in
    one column ``row``, so that no name can clash.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("__points"),
        normalised(F.col(text_col)).alias("__norm"),
        *([F.struct(*[F.col(name) for name in keep]).alias("row")] if keep else []),
    )
    own = ["row"] if keep else []
    hashed = rows.withColumn("__hash", F.xxhash64("__norm"))
    # A text may fill a quarter of an even partition before it is salted, so at most four texts per partition are hot.
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    often = 1 + docs.count() // (4 * parts)
    hot = hashed.groupBy("__hash").count().where(F.col("count") > often).collect()
    salts = spark.createDataFrame(
        [(r["__hash"], -(-r["count"] // often)) for r in hot], "__hash long, __salts long"
    )
    dealt = (
        hashed.join(F.broadcast(salts), "__hash", "left")
        .withColumn("__salt", F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(7)), "__salts"), F.lit(0)))
        .withColumn("__prefix", F.substring("__norm", 1, PREFIX))
        .repartitionByRange(parts, "__prefix", "__hash", "__salt")
    )
    group = ["__prefix", "__hash", "__salts", "__salt", "__norm"]
    best = [F.col("__points").desc(), F.col("doc_id").asc_nulls_last()]
    ordered = Window.partitionBy(*group).orderBy(*best)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = dealt.select(
        *own, "doc_id", "__hash", "__points", "__salts", "__norm",
        F.sha2(F.col("__norm").cast("binary"), 256).alias("text_sha256"),
        F.first("doc_id").over(whole).alias("keep_id"),
        F.count(F.lit(1)).over(whole).alias("group_size"),
        F.row_number().over(ordered).alias("__place"),
    )
    cold = found.where(F.col("__salts").isNull())
    plain = cold.select(
        *own, "doc_id", "keep_id", "group_size", (F.col("__place") == 1).alias("kept"), "text_sha256",
    )
    if not hot:
        return plain
    return plain.unionByName(_across_salts(found.where(F.col("__salts").isNotNull()), best, own))


def _across_salts(found: DataFrame, best: list[Column], own: list[str]) -> DataFrame:
    """Rows of salted texts, with the group's result over all salts."""
    heads = found.where(F.col("__place") == 1)
    text = Window.partitionBy("__norm")
    first = text.orderBy(*best)
    groups = heads.select(
        "text_sha256", F.col("keep_id").alias("__head"), F.row_number().over(first).alias("__rank"),
        F.first("keep_id").over(first).alias("__keep"), F.sum("group_size").over(text).alias("__size"),
    )
    # One row for each salt of a hot text: bounded by the number of partitions, whatever the number of rows.
    local = found.select(*own, "doc_id", "text_sha256", F.col("keep_id").alias("__head"), "__place")
    joined = local.join(F.broadcast(groups), (local["text_sha256"] == groups["text_sha256"])
                        & local["__head"].eqNullSafe(groups["__head"]))
    return joined.select(
        *own, local["doc_id"], F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"),
        ((F.col("__place") == 1) & (F.col("__rank") == 1)).alias("kept"), local["text_sha256"],
    )


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST)"""


@query(SQL)
def op9_exact_dedup(spark, folder):
    """Which documents are copies of which, white space aside."""
    return exact_duplicates(read(spark, folder, "documents"))
