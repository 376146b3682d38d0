"""Descriptives, histograms and two-sample tests from aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from stillwave.operators.chunked import as_col
from stillwave.operators.quantiles import median_and_mode


def describe(df: DataFrame, columns: Sequence[str], population: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """n, min, max, mean and SD (sample unless ``population``) in long form, one row per column."""
    sd = F.stddev_pop if population else F.stddev_samp
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_p")).select(
        *keys, "_p.name", "_p.value")
    return long.groupBy(*keys, "name").agg(
        F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), sd("value").alias("sd"))


def mean_without_nan(column: str | Column) -> Column:
    return F.avg(F.nanvl(as_col(column).cast("double"), F.lit(None).cast("double")))


def histogram(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Counts per bin ``[e_i, e_i+1)``, the last bin closed; values outside the edges are left out."""
    v = F.col(value)
    bin_no = F.lit(-1)
    for e in edges[:-1]:
        bin_no = bin_no + (v >= e).cast("int")
    counted = df.filter(v.between(edges[0], edges[-1])).groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = df.sparkSession.createDataFrame(
        [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, low double, high double")
    return bins.join(counted, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def levene(df: DataFrame, group: str, value: str, cell: float = 1 / 64) -> DataFrame:
    """Median-centred Levene statistic over the groups: one row ``(w, df1, df2)``."""
    medians = median_and_mode(df.select(group, F.col(value).cast("double").alias("value")), [group], cell=cell)
    rows = df.join(medians.select(group, "median"), group).select(
        group, F.abs(F.col(value) - F.col("median")).alias("z"))
    per_group = rows.groupBy(group).agg(
        F.count("z").alias("n"), F.avg("z").alias("m"), F.var_pop("z").alias("v"))
    total = per_group.agg(
        F.sum("n").alias("_N"), F.count(F.lit(1)).alias("_k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_zm"),
        F.sum(F.col("n") * F.col("v")).alias("_within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("_sq"))
    between = F.col("_sq") - F.col("_N") * F.col("_zm") * F.col("_zm")
    return total.select(
        ((F.col("_N") - F.col("_k")) * between / ((F.col("_k") - 1) * F.col("_within"))).alias("w"),
        (F.col("_k") - 1).cast("double").alias("df1"), (F.col("_N") - F.col("_k")).cast("double").alias("df2"))


def t_test(df: DataFrame, group: str, first: str, second: str, value: str, equal_var: bool = True) -> DataFrame:
    """Independent two-sample t statistic, pooled or Welch: one row ``(t, df)``."""
    v = lambda g: F.when(F.col(group) == g, F.col(value).cast("double"))
    s = df.agg(*[f(v(g)).alias(f"_{k}{i}") for i, g in ((1, first), (2, second))
                 for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    n1, n2, v1, v2 = F.col("_n1"), F.col("_n2"), F.col("_v1"), F.col("_v2")
    if equal_var:
        freedom = n1 + n2 - 2
        scale = ((n1 - 1) * v1 + (n2 - 1) * v2) / freedom * (1 / n1 + 1 / n2)
    else:
        a, b = v1 / n1, v2 / n2
        scale = a + b
        freedom = (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1))
    return s.select(((F.col("_m1") - F.col("_m2")) / F.sqrt(scale)).alias("t"), freedom.cast("double").alias("df"))


def f_tail(statistic: str | Column, df1: str | Column, df2: str | Column) -> Column:
    """P(F > statistic)."""
    f, d1, d2 = as_col(statistic), as_col(df1), as_col(df2)
    return _incomplete_beta()(d2 / 2, d1 / 2, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))


def t_two_sided(statistic: str | Column, df: str | Column) -> Column:
    """P(|T| > |statistic|)."""
    t, d = as_col(statistic), as_col(df)
    return _incomplete_beta()(d / 2, F.lit(0.5), d / (d + t * t), t * t / (d + t * t))


def _incomplete_beta():
    """Regularised incomplete beta I_x(a, b) by its continued fraction (one row per test); takes a, b, x and 1 - x."""
    from math import exp, lgamma, log, log1p

    def log_beta(a: float, b: float) -> float:
        """log of gamma(a) gamma(b) / gamma(a + b), without cancellation for large arguments."""
        a, b = max(a, b), min(a, b)
        if a < 1e4:
            return lgamma(a) + lgamma(b) - lgamma(a + b)
        rise = (a + b - 0.5) * log1p(b / a) + b * log(a) - b + 1 / (12 * (a + b)) - 1 / (12 * a)
        return lgamma(b) - rise

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
        d = 1.0 / (d if abs(d) > tiny else tiny)
        out, m = d, 0
        while True:
            m += 1
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                        -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 + top * d
                d = 1.0 / (d if abs(d) > tiny else tiny)
                c = 1.0 + top / c
                c = c if abs(c) > tiny else tiny
                out *= c * d
            if abs(c * d - 1.0) < 1e-15:
                return out
            if m > 10_000_000:
                raise ArithmeticError("the continued fraction does not settle")

    def one(a: float, b: float, x: float, y: float) -> float:
        if not 0.0 < x < 1.0 or y <= 0.0:
            return 0.0 if x <= 0 else 1.0
        log_x, log_y = log1p(-y) if y < 0.5 else log(x), log1p(-x) if x < 0.5 else log(y)
        front = exp(a * log_x + b * log_y - log_beta(a, b))
        if x < (a + 1) / (a + b + 2):
            return front * fraction(a, b, x) / a
        return 1.0 - front * fraction(b, a, y) / b

    @F.pandas_udf("double")
    def beta(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([one(*row) for row in zip(a, b, x, y)], dtype="float64")

    return beta
