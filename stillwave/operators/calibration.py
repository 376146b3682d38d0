"""Auto-calibration: stationary segment means, fitted weights, sparsity gate."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stillwave.functions.expressions import WEIGHTS
from stillwave.operators.blocks import AXES
from stillwave.operators.chunked import div
from stillwave.session import cut_lineage

SUBJECT = ("subject",)


def stationary_means(signal: DataFrame, threshold: float, rows: int, idx: str = "idx",
                     keys: Sequence[str] = SUBJECT) -> DataFrame:
    """Mean of the two-point moving average of each segment that is quiet on all axes.

    The mean over all pairs is ``(2 * sum - first - last) / (2 * (n - 1))``,
    so a segment is one aggregated row and needs no row window.
    """
    aggs = [F.count(F.lit(1)).alias("_n")]
    for a in AXES:
        aggs += [F.sum(a).alias(f"_s_{a}"), F.min_by(a, idx).alias(f"_f_{a}"), F.max_by(a, idx).alias(f"_l_{a}"),
                 F.stddev_pop(a).alias(f"_d_{a}")]
    segments = signal.groupBy(*keys, div(idx, rows).alias("segment")).agg(*aggs)
    quiet = (F.col("_d_y") <= threshold) & (F.col("_d_x") <= threshold) & (F.col("_d_z") <= threshold)
    return segments.filter(quiet).select(
        *keys, "segment",
        *[F.try_divide(2 * F.col(f"_s_{a}") - F.col(f"_f_{a}") - F.col(f"_l_{a}"), 2.0 * (F.col("_n") - 1)).alias(a)
          for a in AXES])


def sparsity_gate(points: DataFrame, keys: Sequence[str] = SUBJECT, high: float = 0.3, low: float = 0.3,
                  high_all_axes: bool = False) -> DataFrame:
    """``fit``: whether the points spread enough over the sphere to be fitted.

    Some value above ``high`` (on every axis with ``high_all_axes``, else on
    any) and some value below ``low`` on any axis.
    """
    above, below = F.lit(None).cast("boolean"), F.lit(False)
    for i, a in enumerate(AXES):
        hit = F.max(a) > high
        above = hit if i == 0 else (above & hit if high_all_axes else above | hit)
        below = below | (F.min(a) < low)
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), (above & below).alias("fit"))


def fit_weights(points: DataFrame, keys: Sequence[str] = SUBJECT, rounds: int = 8, ridge: float = 1e-9) -> DataFrame:
    """Weights t, b per key that bring ``|x * t + b|`` closest to 1 in the mean square.

    Gauss-Newton from the identity: each round adds up the 6 x 6 normal
    equations per key (27 sums with a map-side combine) and solves one small
    system per key. Points are never gathered per subject.
    """
    points = cut_lineage(points.select(*keys, *AXES))
    one = {w: F.lit(1.0 if w.startswith("t") else 0.0) for w in WEIGHTS}
    weights = cut_lineage(points.select(*keys).distinct().select(*keys, *[c.alias(w) for w, c in one.items()]))
    for _ in range(rounds):
        weights = cut_lineage(_gauss_newton(points, weights, keys, ridge))
    return weights


def _gauss_newton(points: DataFrame, weights: DataFrame, keys: Sequence[str], ridge: float) -> DataFrame:
    rows = points.join(weights, list(keys))
    placed = {a: F.col(a) * F.col(f"t_{a}") + F.col(f"b_{a}") for a in AXES}
    rows = rows.select("*", *[c.alias(f"_p_{a}") for a, c in placed.items()])
    norm = F.sqrt(sum((F.col(f"_p_{a}") * F.col(f"_p_{a}") for a in AXES), F.lit(0.0)))
    rows = rows.select("*", norm.alias("_norm")).filter("_norm > 0")
    unit = {a: F.col(f"_p_{a}") / F.col("_norm") for a in AXES}
    slopes = [unit[a] * F.col(a) for a in AXES] + [unit[a] for a in AXES]
    rows = rows.select(*keys, *WEIGHTS, (F.col("_norm") - 1).alias("_r"), *[s.alias(f"_j{i}") for i, s in enumerate(slopes)])
    sums = [F.sum(F.col(f"_j{i}") * F.col(f"_j{j}")).alias(f"_a{i}{j}") for i in range(6) for j in range(i, 6)]
    sums += [F.sum(F.col(f"_j{i}") * F.col("_r")).alias(f"_g{i}") for i in range(6)]
    normal = rows.groupBy(*keys).agg(*[F.first(w).alias(w) for w in WEIGHTS], F.count(F.lit(1)).alias("_n"), *sums)
    system = F.array(*[F.col(f"_a{min(i, j)}{max(i, j)}") for i in range(6) for j in range(6)],
                     *[F.col(f"_g{i}") for i in range(6)])
    step = _solver(ridge)(system)
    solved = normal.select(*keys, *WEIGHTS, step.alias("_step"))
    return solved.select(*keys, *[(F.col(w) - F.col("_step")[i]).alias(w) for i, w in enumerate(WEIGHTS)])


def _solver(ridge: float):
    @F.pandas_udf("array<double>")
    def solve(system: pd.Series) -> pd.Series:
        flat = np.stack(system.to_numpy())
        a, g = flat[:, :36].reshape(-1, 6, 6), flat[:, 36:]
        damp = ridge * np.maximum(np.trace(a, axis1=1, axis2=2), 1.0)
        steps = np.linalg.solve(a + damp[:, None, None] * np.eye(6), g[:, :, None])[:, :, 0]
        return pd.Series(list(steps))

    return solve


def calibration_weights(points: DataFrame, keys: Sequence[str] = SUBJECT, high_all_axes: bool = False,
                        rounds: int = 8) -> DataFrame:
    """Fitted weights where the gate allows it, identity weights elsewhere."""
    gate = sparsity_gate(points, keys, high_all_axes=high_all_axes)
    fitted = fit_weights(points.join(gate.filter("fit").select(*keys), list(keys), "left_semi"), keys, rounds)
    return gate.join(fitted, list(keys), "left").select(
        *keys, "fit", *[F.coalesce(F.col(w), F.lit(1.0 if w.startswith("t") else 0.0)).alias(w) for w in WEIGHTS])
