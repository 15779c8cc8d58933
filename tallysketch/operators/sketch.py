"""The user-facing sketch: an immutable, lazily planned register table with its parameters."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashes import HashFunction, get_hash
from .estimate import estimate_registers
from .registers import build_registers, check_groups, check_p, dense_registers, merge_registers, rank_histogram, zero_count

# Parts of a saved sketch: what it is, its registers, and the folder columns there.
ABOUT, REGISTERS, FOLDER = "about", "registers", "folder_"


@dataclass(frozen=True)
class Sketch:
    """Distinct-count sketch of one key column, optionally one per group."""

    registers: DataFrame
    p: int = 14
    hash: str = "murmur3_32"
    by: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        check_p(self.p)
        check_groups(self.by)
        get_hash(self.hash)

    @classmethod
    def build(
        cls, df: DataFrame, key: str, p: int = 14, hash: str | HashFunction = "murmur3_32", by: Sequence[str] = (),
        padding: str = "drop",
    ) -> Sketch:
        spec = get_hash(hash)
        return cls(build_registers(df, key, p, spec, by, padding), p, spec.name, tuple(by))

    def _check_same_kind(self, other: Sketch) -> None:
        if self.p != other.p:
            raise ValueError(f"cannot merge sketches with p={self.p} and p={other.p}")
        if self.hash != other.hash:
            raise ValueError(f"cannot merge sketches hashed with {self.hash} and {other.hash}")
        if self.by != other.by:
            raise ValueError(f"cannot merge sketches grouped by {self.by} and {other.by}")

    def merge(self, *others: Sketch) -> Sketch:
        """Sketch of the union of the inputs; chainable."""
        for other in others:
            self._check_same_kind(other)
        merged = merge_registers(self.registers, *[o.registers for o in others], by=self.by)
        return Sketch(merged, self.p, self.hash, self.by)

    def roll_up(self, by: Sequence[str] = ()) -> Sketch:
        """Coarser groups from the registers alone, without reading the keys again."""
        extra = set(by) - set(self.by)
        if extra:
            raise ValueError(f"not grouped by {sorted(extra)}")
        return Sketch(merge_registers(self.registers, by=by), self.p, self.hash, tuple(by))

    def estimate(self, large_range: str = "none") -> DataFrame:
        return estimate_registers(self.registers, self.p, get_hash(self.hash).width, self.by, large_range)

    def histogram(self) -> DataFrame:
        return rank_histogram(self.registers, self.by)

    def zeros(self) -> DataFrame:
        return zero_count(self.registers, self.p, self.by)

    def dense(self) -> DataFrame:
        return dense_registers(self.registers, self.p, self.by)

    def table(self) -> DataFrame:
        """The registers with the parameters they were built with, as stored on disk."""
        return self.registers.select(
            F.lit(self.p).alias("p"), F.lit(self.hash).alias("hash"), *self.by, "bucket", "rank"
        )

    def save(self, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
        """Write the sketch: Parquet files of registers, and a one-row table that says what they are.

        ``partition_by`` names group columns whose values also become folder names, to read single groups quickly.  The
        values themselves stay in the files: folder names can't tell NULL from an empty text or ``'007'`` from 7.
        """
        missing = set(partition_by) - set(self.by)
        if missing:
            raise ValueError(f"not grouped by {sorted(missing)}")
        spark = self.registers.sparkSession
        kept = self.registers.select(*self.by, "bucket", "rank")
        about = [(self.p, self.hash, kept.schema.json(), list(partition_by))]
        schema = "p INT, hash STRING, schema STRING, folders ARRAY<STRING>"
        folders = {f"{FOLDER}{i}": F.concat(F.lit("="), F.col(c).cast("string")) for i, c in enumerate(partition_by)}
        if mode == "append" and _exists(spark, f"{path}/{ABOUT}"):
            if spark.read.parquet(f"{path}/{ABOUT}").collect() != spark.createDataFrame(about, schema).collect():
                raise ValueError(f"{path} holds sketches of another kind")
        else:
            spark.createDataFrame(about, schema).coalesce(1).write.mode(mode).parquet(f"{path}/{ABOUT}")
        kept.withColumns(folders).write.mode(mode).partitionBy(*folders).parquet(f"{path}/{REGISTERS}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, by: Sequence[str] | None = None) -> Sketch:
        """Reload a saved sketch; ``by`` names the group columns to keep, all by default.

        Registers appended by several saves are merged.
        """
        about = spark.read.parquet(f"{path}/{ABOUT}").first()
        schema = T.StructType.fromJson(json.loads(about["schema"]))
        groups = [f.name for f in schema if f.name not in ("bucket", "rank")]
        folders = [T.StructField(f"{FOLDER}{i}", T.StringType()) for i in range(len(about["folders"]))]
        stored = spark.read.schema(T.StructType([*schema.fields, *folders])).parquet(f"{path}/{REGISTERS}")
        whole = cls(stored.select(*groups, "bucket", "rank"), about["p"], about["hash"], tuple(groups))
        return whole.roll_up(groups if by is None else by)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)


def approx_distinct(
    df: DataFrame, key: str, p: int = 14, hash: str | HashFunction = "murmur3_32", by: Sequence[str] = (),
    large_range: str = "none",
) -> DataFrame:
    """Build and estimate in one call: ``(by..., estimate, zeros, harmonic, raw)``."""
    return Sketch.build(df, key, p, hash, by).estimate(large_range)
