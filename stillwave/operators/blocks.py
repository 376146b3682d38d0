"""Block statistics: the step that turns raw samples into a small table.

Every raw-signal operator starts from these tables, so the only shuffle over
raw samples is one aggregation with a map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stillwave.operators.chunked import as_col, div

AXES = ("y", "x", "z")
SUBJECT = ("subject",)


def pooled_std(n: str | Column, total: str | Column, squares: str | Column) -> Column:
    """Population standard deviation from count, sum and sum of squares."""
    n, total, squares = as_col(n), as_col(total), as_col(squares)
    return F.sqrt(F.greatest(n * squares - total * total, F.lit(0.0))) / n


def block_stats(
    signal: DataFrame, block_rows: int, idx: str = "idx", keys: Sequence[str] = SUBJECT,
    axes: Sequence[str] = AXES,
) -> DataFrame:
    """``n`` and per axis ``sum, sumsq, min, max`` of tumbling blocks (short tail kept)."""
    per_axis = []
    for a in axes:
        c = F.col(a)
        per_axis += [
            F.sum(c).alias(f"sum_{a}"), F.sum(c * c).alias(f"sumsq_{a}"),
            F.min(c).alias(f"min_{a}"), F.max(c).alias(f"max_{a}"),
        ]
    return signal.groupBy(*keys, div(idx, block_rows).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.min(idx).alias("first_idx"), F.max(idx).alias("last_idx"), *per_axis)


def block_spread(blocks: DataFrame, axes: Sequence[str] = AXES) -> DataFrame:
    """Add ``std_<axis>`` and ``range_<axis>``."""
    return blocks.select(
        "*",
        *[pooled_std("n", f"sum_{a}", f"sumsq_{a}").alias(f"std_{a}") for a in axes],
        *[(F.col(f"max_{a}") - F.col(f"min_{a}")).alias(f"range_{a}") for a in axes],
    )
