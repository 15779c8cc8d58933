"""Table functions in SQL: packed sketches or registers in, one estimate for each partition of the argument out."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.estimate import SMALL_RANGE_FACTOR, alpha
from ..operators.packed import unpack
from ..operators.registers import check_p, register_count

ESTIMATES, HISTOGRAM = "estimate", "histogram"
SKETCH_COLUMNS = frozenset(["packed", "bucket", "rank"])
OUTPUTS = {
    ESTIMATES: StructType([
        StructField("estimate", DoubleType()), StructField("zeros", LongType()), StructField("harmonic", DoubleType()),
        StructField("raw", DoubleType()),
    ]),
    HISTOGRAM: StructType([StructField("rank", IntegerType()), StructField("registers", LongType())]),
}


@udtf
class TallySketch:
    """``tally_sketch(TABLE(...) PARTITION BY (...), p, output)`` over packed sketches (a column ``packed``) or registers (columns
    ``bucket`` and ``rank``).

    ``output`` is ``'estimate'`` (estimate, zeros, harmonic, raw) or ``'histogram'`` (a row for each rank in use), and decides the
    last columns; the table's other columns come first, as the partition's first row has them. All rows of a partition are folded into one array of ``2^p`` bytes; of a bucket that repeats the largest rank
    counts, and NULLs add nothing. Rows are seen one by one, so give it packed sketches where registers are many.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, p: AnalyzeArgument, output: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument must be a TABLE")
        names = {f.name for f in table.dataType.fields}
        if "packed" not in names and not {"bucket", "rank"} <= names:
            raise ValueError("the table needs a column packed, or bucket and rank")
        if not p.isConstantExpression or not output.isConstantExpression:
            raise ValueError("p and output must be constants")
        check_p(p.value)
        if output.value not in OUTPUTS:
            raise ValueError(f"output must be {' or '.join(OUTPUTS)}, got {output.value!r}")
        groups = [f for f in table.dataType.fields if f.name not in SKETCH_COLUMNS]
        return AnalyzeResult(StructType([*groups, *OUTPUTS[output.value].fields]))

    def __init__(self) -> None:
        self.registers = None

    def eval(self, row: Row, p: int, output: str) -> None:
        if self.registers is None:
            self.p, self.output = p, output
            self.registers = np.zeros(register_count(p), np.uint8)
            self.packed = "packed" in row
            self.group = tuple(value for name, value in row.asDict().items() if name not in SKETCH_COLUMNS)
        if self.packed:
            if row["packed"] is not None:
                np.maximum(self.registers, unpack(bytes(row["packed"]), self.p), out=self.registers)
        elif row["bucket"] is not None and (row["rank"] or 0) > self.registers[row["bucket"]]:
            self.registers[row["bucket"]] = row["rank"]

    def terminate(self) -> Iterator[tuple]:
        if self.registers is None:
            return
        counts = np.bincount(self.registers).tolist()
        if self.output == HISTOGRAM:
            yield from ((*self.group, rank, count) for rank, count in enumerate(counts) if rank and count)
            return
        harmonic = sum(count * 2.0 ** -rank for rank, count in enumerate(counts))
        m, zeros = register_count(self.p), counts[0]
        raw = alpha(self.p) * m * m / harmonic
        estimate = m * math.log(m / zeros) if zeros and raw <= SMALL_RANGE_FACTOR * m else raw
        yield *self.group, estimate, zeros, harmonic, raw


def register_table_functions(spark: SparkSession) -> list[str]:
    """Create the session's table functions and return their names."""
    spark.udtf.register("tally_sketch", TallySketch)
    return ["tally_sketch"]
