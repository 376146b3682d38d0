"""Classification metrics from confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stillwave.operators.chunked import as_col

METRICS = ("accuracy", "precision", "specificity", "recall", "f1", "ppv", "npv")


def confusion(truth: str | Column, predicted: str | Column, weight: Column | None = None) -> list[Column]:
    """Aggregates tn, fp, fn, tp of two 0/1 columns (positive = 1)."""
    y, p = as_col(truth), as_col(predicted)
    w = F.lit(1) if weight is None else weight
    cell = lambda a, b: F.coalesce(F.sum(F.when((y == a) & (p == b), w).otherwise(F.lit(0))), F.lit(0)).cast("long")
    return [cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")]


def metric_columns(tn="tn", fp="fp", fn="fn", tp="tp") -> list[Column]:
    """accuracy … npv; an empty denominator gives null."""
    tn, fp, fn, tp = (as_col(c).cast("double") for c in (tn, fp, fn, tp))
    ratio = F.try_divide
    precision = ratio(tp, tp + fp)
    return [
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        precision.alias("precision"),
        ratio(tn, tn + fp).alias("specificity"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        precision.alias("ppv"),
        ratio(tn, tn + fn).alias("npv"),
    ]


def with_metrics(counts: DataFrame) -> DataFrame:
    return counts.select("*", *metric_columns())


def sum_confusion(counts: DataFrame, *keys: str) -> DataFrame:
    """Confusion counts added up over everything but ``keys``."""
    return counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])


def half_width(p: str | Column, n: int | Column) -> Column:
    """Half-width of the 95 % interval of a proportion."""
    p = as_col(p)
    return 1.96 * F.sqrt(p * (1 - p) / n)


def with_interval_text(p: str | Column, n: int | Column) -> Column:
    """``0.812 ± 0.032``, both rounded to three digits."""
    p3 = F.round(as_col(p), 3)
    return F.format_string("%.3f ± %.3f", p3, F.round(half_width(p3, n), 3))
