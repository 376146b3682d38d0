"""Exact median and smallest mode of groups of any size.

Values are counted first (map-side combined); the rank search runs over
distinct values, cut into cells of the value axis, so a group of any size is
spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from stillwave.operators.chunked import running_total


def median_and_mode(df: DataFrame, keys: Sequence[str], value: str = "value", cell: float = 1 / 64) -> DataFrame:
    """``(keys, n, median, mode)``; ``cell`` is the width of a value cell."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"))
    totals = counts.groupBy(*keys).agg(
        F.sum("_c").alias("n"), F.max_by("_v", F.struct("_c", -F.col("_v"))).alias("mode"))
    ranked = running_total(counts, keys, ["_v"], F.floor(F.col("_v") / cell), {"_upto": F.col("_c")})
    joined = ranked.join(totals, list(keys))
    holds = lambda rank: F.when((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_c") < rank), F.col("_v"))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    return joined.groupBy(*keys).agg(
        F.first("n").alias("n"), ((F.max(holds(low)) + F.max(holds(high))) / 2).alias("median"),
        F.first("mode").alias("mode"))
