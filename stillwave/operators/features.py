"""Features of candidate segments and distances between two signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stillwave.functions.expressions import signal_to_noise
from stillwave.operators.chunked import DEFAULT_SIZE, OWN, chunk_window, div, row_index, spread
from stillwave.operators.quantiles import median_and_mode

SEGMENT = ("subject", "counter")
SIGNALS = ("a", "b", "c")
STATS = ("std", "mean", "min", "max", "kur", "signal_to_noise", "mode", "median", "ptp", "var")
FEATURES = tuple(f"{s}_{k}" for k in STATS for s in (*SIGNALS, "ab_diff")) + ("ab_dtw_1",)


def segment_features(
    joined: DataFrame, keys: Sequence[str] = SEGMENT, idx: str = "idx", size: int = DEFAULT_SIZE,
    cell: float = 1 / 64,
) -> DataFrame:
    """41 features per segment from aligned signals ``a``, ``b`` and ``c``.

    Ten statistics of each signal, their b - a differences, and the lower
    bound of the time-warping distance. Kurtosis of a constant is null.
    """
    plain = []
    for s in SIGNALS:
        c = F.col(s)
        plain += [
            F.stddev_pop(c).alias(f"{s}_std"), F.avg(c).alias(f"{s}_mean"), F.min(c).alias(f"{s}_min"),
            F.max(c).alias(f"{s}_max"), F.kurtosis(c).alias(f"{s}_kur"), F.var_pop(c).alias(f"{s}_var"),
        ]
    basic = joined.groupBy(*keys).agg(*plain)
    long = joined.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(s).alias("sig"), F.col(s).cast("double").alias("value")) for s in SIGNALS])).alias("_p")).select(
        *keys, "_p.sig", "_p.value")
    ranked = median_and_mode(long, [*keys, "sig"], cell=cell)
    wide = ranked.groupBy(*keys).agg(*[
        F.max(F.when(F.col("sig") == s, F.col(k))).alias(f"{s}_{k}") for s in SIGNALS for k in ("median", "mode")])
    bound = keogh_bound(joined, "b", "a", 1, keys, idx, size).withColumnRenamed("lb_keogh", "ab_dtw_1")
    full = basic.join(wide, list(keys)).join(bound, list(keys))
    for s in SIGNALS:
        full = full.withColumn(f"{s}_ptp", F.col(f"{s}_max") - F.col(f"{s}_min")).withColumn(
            f"{s}_signal_to_noise", signal_to_noise(F.col(f"{s}_mean"), F.col(f"{s}_std")))
    for k in STATS:
        full = full.withColumn(f"ab_diff_{k}", F.col(f"b_{k}") - F.col(f"a_{k}"))
    return full.select(*keys, *FEATURES)


def keogh_bound(
    joined: DataFrame, first: str, second: str, radius: int, keys: Sequence[str] = SEGMENT,
    idx: str = "idx", size: int = DEFAULT_SIZE,
) -> DataFrame:
    """LB_Keogh of ``first`` against the envelope of ``second``.

    The envelope of position ``i`` spans positions ``[i-r, i+r)``.
    """
    placed = row_index(joined.select(*keys, idx, first, second), keys, [idx], div(idx, size), "_pos")
    rows = spread(placed, keys, "_pos", size, radius, radius - 1)
    frame = chunk_window(keys, "_pos").rowsBetween(-radius, radius - 1)
    rows = rows.withColumn("_lo", F.min(second).over(frame)).withColumn("_hi", F.max(second).over(frame)).filter(OWN)
    x = F.col(first)
    excess = F.when(x > F.col("_hi"), x - F.col("_hi")).when(x < F.col("_lo"), F.col("_lo") - x).otherwise(F.lit(0.0))
    return rows.groupBy(*keys).agg(F.sqrt(F.sum(excess * excess)).alias("lb_keogh"))


def array_keogh_bound(first: Column, second: Column, radius: int) -> Column:
    """The same bound for two arrays in one row (arrays of bounded length)."""
    def excess(x: Column, i: Column) -> Column:
        low = F.greatest(i - radius, F.lit(0))
        part = F.slice(second, low + 1, i + radius - low)
        hi, lo = F.array_max(part), F.array_min(part)
        d = F.when(x > hi, x - hi).when(x < lo, lo - x).otherwise(F.lit(0.0))
        return d * d
    return F.sqrt(F.aggregate(F.transform(first, excess), F.lit(0.0), lambda acc, v: acc + v))


def array_distance(first: Column, second: Column) -> Column:
    """Euclidean distance of two arrays of the same bounded length."""
    squares = F.zip_with(first, second, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v))


def euclidean_distance(joined: DataFrame, first: str, second: str, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Euclidean distance of two aligned signals per key."""
    d = F.col(first) - F.col(second)
    return joined.groupBy(*keys).agg(F.sqrt(F.sum(d * d)).alias("distance"))
