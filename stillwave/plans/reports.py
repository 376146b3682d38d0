"""Result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stillwave.functions.expressions import in_daytime
from stillwave.functions.metrics import METRICS, confusion, half_width, with_interval_text, with_metrics
from stillwave.operators.align import edge_windows
from stillwave.operators.overlay import weighted_variants
from stillwave.plans.grid import best_row


def method_totals(matrix: DataFrame, methods: Sequence[str], ts: str | None = "ts", truth: str = "truth",
                  start: str = "07:00:00", stop: str = "23:00:00") -> DataFrame:
    """Confusion counts and metrics per method: all day, and daytime only.

    Rows are unpivoted and folded map-side; nothing but the counts is shuffled.
    """
    variants = F.array(F.lit("all"), F.when(in_daytime(ts, start, stop), "daytime")) if ts else F.array(F.lit("all"))
    long = matrix.select(F.col(truth).alias("_y"), F.explode(variants).alias("variant"), *methods).filter(
        "variant IS NOT NULL").unpivot(["_y", "variant"], list(methods), "method", "_p")
    return with_metrics(long.groupBy("variant", "method").agg(*confusion("_y", "_p")))


def overlay_totals(ranges: DataFrame, methods: Sequence[str], started: str | Column, truth: str = "truth",
                   first: int = 7 * 3600, last: int = 23 * 3600) -> DataFrame:
    """As ``method_totals`` for ranges with one label vector each, which count as often as they are long."""
    counted = weighted_variants(ranges, started, first, last).groupBy("variant", truth, *methods).agg(F.sum("n").alias("n"))
    long = counted.select(F.col(truth).alias("_y"), "variant", "n", *methods).unpivot(
        ["_y", "variant", "n"], list(methods), "method", "_p")
    return with_metrics(long.groupBy("variant", "method").agg(*confusion("_y", "_p", F.col("n"))))


def intervals(results: DataFrame, n: int | Column, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Half-width of the 95 % interval of every metric, as ``<metric>_ci``."""
    return results.select("*", *[half_width(m, n).alias(f"{m}_ci") for m in metrics])


def interval_texts(results: DataFrame, n: int | Column, metrics: Sequence[str] = METRICS) -> DataFrame:
    return results.select(*[c for c in results.columns if c not in metrics],
                          *[with_interval_text(m, n).alias(m) for m in metrics])


def default_and_best(results: DataFrame, defaults: Mapping[str, object], metric: str,
                     metrics: Sequence[str] = METRICS) -> DataFrame:
    """Metrics of the default parameters beside those of the best row: ``(metric, default_value, best_value)``."""
    is_default = F.lit(True)
    for name, value in defaults.items():
        is_default = is_default & (F.col(name) == F.lit(value))
    best = best_row(results, metric, [], list(defaults)).unpivot([], list(metrics), "metric", "best_value")
    base = results.filter(is_default).unpivot([], list(metrics), "metric", "default_value")
    return base.select("metric", "default_value").join(best.select("metric", "best_value"), "metric")


def transpose(results: DataFrame, name: str, columns: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Rows named by ``name`` become columns; one row per metric."""
    long = results.unpivot([name], list(columns), "metric", "value")
    return long.groupBy("metric").pivot(name, list(labels)).agg(F.first("value"))


def heat_map(results: DataFrame, row: str, column: str, values: Sequence, metric: str) -> DataFrame:
    """``row`` x ``column`` table of a metric."""
    return results.groupBy(row).pivot(column, list(values)).agg(F.first(metric))


def best_of_each(tables: Mapping[str, DataFrame], metric: str, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Best row of every method in one overview."""
    out = None
    for name, df in tables.items():
        top = best_row(df.select(*metrics), metric).select(F.lit(name).alias("method"), *metrics)
        out = top if out is None else out.unionByName(top)
    return out


def merged_text(left: str | Column, right: str | Column) -> Column:
    """One column out of two synonymous ones: the smaller text, ``-`` when both are missing."""
    l, r = (c if isinstance(c, Column) else F.col(c) for c in (left, right))
    return F.coalesce(F.least(l, r), F.lit("-"))


def last_epoch(history: DataFrame, keys: Sequence[str], epoch: str = "epoch") -> DataFrame:
    """Training history with F1, reduced to the last epoch per network."""
    columns = [c for c in history.columns if c not in keys]
    return history.groupBy(*keys).agg(F.max_by(F.struct(*columns), epoch).alias("_h")).select(*keys, "_h.*")


def history_f1(history: DataFrame) -> DataFrame:
    """F1 from the precision and recall columns of training and validation."""
    f1 = lambda p, r: F.try_divide(2 * F.col(p) * F.col(r), F.col(p) + F.col(r))
    return history.select("*", f1("precision", "recall").alias("f1"), f1("val_precision", "val_recall").alias("val_f1"))


def _array_std(column: str, field: str) -> Column:
    """Population standard deviation of one field of an array of structs (bounded length)."""
    values = F.transform(column, lambda s: s[field].cast("double"))
    n = F.size(column)
    add = lambda acc, v: acc + v
    mean = F.aggregate(values, F.lit(0.0), add) / n
    return F.sqrt(F.aggregate(F.transform(values, lambda v: (v - mean) * (v - mean)), F.lit(0.0), add) / n)


def lively_edges(signal: DataFrame, episodes: DataFrame, rows: int, min_std: float = 0.1, per_class: int | None = None,
                 ) -> DataFrame:
    """Edge windows whose standard deviation exceeds ``min_std`` on every axis, a few per class."""
    windows = edge_windows(signal, episodes, rows)
    for axis in ("y", "x", "z"):
        windows = windows.withColumn(f"std_{axis}", _array_std("w", axis))
    kept = windows.filter(F.least("std_y", "std_x", "std_z") > min_std)
    if per_class is None:
        return kept
    picks = None
    for side in ("start", "stop"):
        part = kept.filter(F.col("side") == side).orderBy("subject", "counter").limit(per_class)
        picks = part if picks is None else picks.unionByName(part)
    return picks


def per_day(df: DataFrame, columns: Sequence[str], ts: str = "ts") -> DataFrame:
    """Sums and row counts per subject and day."""
    return df.groupBy("subject", F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in columns])


def scenario(timeline: DataFrame, subjects: DataFrame, start: str, stop: str, ts: str = "ts") -> DataFrame:
    """Timeline rows of chosen subjects within a time of day."""
    return timeline.join(subjects.select("subject").distinct(), "subject", "left_semi").filter(in_daytime(ts, start, stop))
