"""Where results go: estimates, payloads, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_result(estimates: DataFrame, path: str, run_id: str | None = None, mode: str = "append") -> None:
    """Append ``(run_id, estimate)`` rows; ``run_id`` is a column name, or run 0 when the frame holds a single run."""
    run = F.col(run_id) if run_id else F.lit(0).cast("bigint")
    estimates.select(run.alias("run_id"), "estimate").write.mode(mode).parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch so that replaying it replaces its rows instead of adding them again."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def write_error_table(report: DataFrame, path: str, order: Sequence[str] = ("cardinality",)) -> None:
    """Tab-separated error table in order of cardinality (one row per checkpoint, so one file)."""
    report.orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)
