"""Running aggregates over an ordered table without an unpartitioned window over its rows.

Rows are cut into blocks of ``2**bits`` consecutive order values.  Each block is aggregated once, the block totals are
accumulated, and every row adds the total of the earlier blocks to a running value inside its own block.  With unique
order values no window over rows ever holds more than ``2**bits`` of them, however large or skewed the groups are.

The totals are cut into blocks again, and the totals of those, as often as the largest order value needs: then the last
window holds at most ``2**bits`` totals, for dense numbers and for sparse ones such as microseconds or hashes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 16


def levels_for(df: DataFrame, order: str, bits: int = BLOCK_BITS) -> int:
    """How often totals must be cut into blocks so that no window holds more than ``2**bits`` of them."""
    largest = df.agg(F.max(F.abs(F.col(order).cast("decimal(20,0)")))).first()[0] or 0
    return max(1, -(-int(largest).bit_length() // bits) - 1)


def _combine(kind: str, column: str, out: str) -> Column:
    return F.expr(f"{kind}({column}) AS {out}")


def _plus(kind: str, *terms: str) -> str:
    return f"({' + '.join(terms)})" if kind == "sum" else f"greatest({', '.join(terms)})"


def _before(kind: str, value: str, keys: str, order: str, start: int) -> str:
    """Aggregate of the rows strictly before the current one in its window."""
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"coalesce({kind}({value}) OVER (PARTITION BY {keys} ORDER BY {order} {frame}), {start}L)"


def _earlier_totals(blocks: DataFrame, kind: str, n: int, bits: int, levels: int, start: int) -> DataFrame:
    """For block totals ``(__group, __block, __total0..)``: the aggregate of all earlier blocks as ``__carry0..``."""
    if levels == 1:
        before = [f"{_before(kind, f'__total{i}', '__group', '__block', start)} AS __carry{i}" for i in range(n)]
        return blocks.selectExpr("__group", "__block", *before)
    tagged = blocks.selectExpr("*", f"shiftright(__block, {bits}) AS __coarse")
    above = tagged.groupBy("__group", F.col("__coarse").alias("__block")).agg(
        *[_combine(kind, f"__total{i}", f"__total{i}") for i in range(n)]
    )
    carried = _earlier_totals(above, kind, n, bits, levels - 1, start).withColumnRenamed("__block", "__coarse")
    before = [f"{_before(kind, f'__total{i}', '__group, __coarse', '__block', start)} AS __inside{i}" for i in range(n)]
    joined = tagged.selectExpr("__group", "__coarse", "__block", *before).join(carried, ["__group", "__coarse"])
    sums = [f"{_plus(kind, f'__carry{i}', f'__inside{i}')} AS __carry{i}" for i in range(n)]
    return joined.selectExpr("__group", "__block", *sums)


def running(
    df: DataFrame, order: str, values: Mapping[str, Column], by: Sequence[str] = (), kind: str = "sum",
    inclusive: bool = True, start: int = 0, bits: int = BLOCK_BITS, levels: int | None = None,
) -> DataFrame:
    """Add running sums or maxima of integer ``values`` (output name -> column) along the integer column ``order``.

    ``order`` must be non-NULL and unique within a ``by`` group, else the query fails.  NULL values count as ``start``,
    which is also the value before the first row.  ``levels`` is found from the data unless it is given (see
    ``levels_for``), which reads the order column once more.
    """
    levels = levels or levels_for(df, order, bits)
    if kind not in ("sum", "max"):
        raise ValueError(f"kind must be 'sum' or 'max', got {kind!r}")
    n = len(values)
    none = F.lit(start).cast("bigint")
    filled = {f"__value{i}": F.coalesce(v.cast("bigint"), none) for i, v in enumerate(values.values())}
    # One struct key: two NULL group values inside it compare equal, so no group is lost in the join.
    group = F.struct(*by) if by else F.lit(0)
    # A block that cannot be NULL needs no filter before the joins, so the readers of the totals share one exchange.
    missing = f"CAST(raise_error('{order} must not be NULL') AS BIGINT)"
    block = f"coalesce(shiftright(coalesce(CAST(`{order}` AS BIGINT), {missing}), {bits}), 0L)"
    tagged = df.withColumns({"__group": group, "__block": F.expr(block), **filled})

    totals = tagged.groupBy("__group", "__block").agg(*[_combine(kind, f"__value{i}", f"__total{i}") for i in range(n)])
    carry = _earlier_totals(totals, kind, n, bits, levels, start)

    # A repeated order value would make the result depend on which of its rows happens to come first.
    twice = f"lag(`{order}`) OVER (PARTITION BY __group, __block ORDER BY `{order}`) = `{order}`"
    failed = f"CAST(raise_error('{order} must be unique within a group') AS BIGINT)"
    before = [
        f"CASE WHEN {twice} THEN {failed} ELSE {_before(kind, f'__value{i}', '__group, __block', f'`{order}`', start)} END"
        f" AS __inside{i}" for i in range(n)
    ]
    joined = tagged.selectExpr("*", *before).join(carry, ["__group", "__block"])
    results = []
    for i, name in enumerate(values):
        terms = [f"__carry{i}", f"__inside{i}"] + ([f"__value{i}"] if inclusive else [])
        results.append(F.expr(_plus(kind, *terms)).alias(name))
    return joined.select(*[c for c in df.columns if c not in values], *results)
