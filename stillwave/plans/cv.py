"""Cross-validated parameter search on a table of confusion counts.

The detectors have already run for every combination; folds, best picks and
hold-out scores are sums and joins over ``(subject, combination)`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stillwave.functions.metrics import METRICS, sum_confusion, with_metrics
from stillwave.operators.chunked import attach_row, row_index
from stillwave.plans.grid import best_row

COUNTS = ("tn", "fp", "fn", "tp")


def sequence_label(truth_runs: DataFrame, subjects: DataFrame) -> DataFrame:
    """Class of a subject: 0 with at most one non-wear run, else 1."""
    counts = truth_runs.groupBy("subject").agg(F.count(F.lit(1)).alias("_n"))
    return subjects.join(counts, "subject", "left").select(
        "subject", F.when(F.coalesce("_n", F.lit(0)) <= 1, 0).otherwise(1).alias("cls"))


def positional_split(subjects: DataFrame, order: Sequence[str], chunk: Column, test_share: float = 0.3) -> DataFrame:
    """Add ``part``: the last ``ceil(share * n)`` subjects in order are the test part."""
    placed = row_index(subjects, [], list(order), chunk, "_pos")
    cut = F.col("_n") - F.ceil(F.col("_n") * test_share)
    return attach_row(placed, subjects.agg(F.count(F.lit(1)).alias("_n"))).withColumn(
        "part", F.when(F.col("_pos") < cut, "train").otherwise("test")).drop("_pos", "_n")


def stratified_folds(subjects: DataFrame, order: Sequence[str], chunk: Column, folds: int = 10) -> DataFrame:
    """Add ``fold`` so that each class is cut into consecutive, nearly equal folds."""
    placed = row_index(subjects, ["cls"], list(order), chunk, "_pos")
    sizes = subjects.groupBy("cls").agg(F.count(F.lit(1)).alias("_n"))
    big = F.floor(F.col("_n") / folds) + 1
    extra = F.col("_n") % folds
    fold = F.when(F.col("_pos") < extra * big, F.floor(F.col("_pos") / big)).otherwise(
        extra + F.floor((F.col("_pos") - extra * big) / F.greatest(big - 1, F.lit(1))))
    return placed.join(sizes, "cls").withColumn("fold", fold.cast("int")).drop("_pos", "_n")


def plain_folds(df: DataFrame, order: Sequence[str], chunk: Column, folds: int = 10) -> DataFrame:
    """Add ``fold`` over all rows, classes ignored."""
    return stratified_folds(df.withColumn("cls", F.lit(0)), order, chunk, folds).drop("cls")


def fold_results(conf: DataFrame, folds: DataFrame, parameters: Sequence[str], metric: str = "f1") -> DataFrame:
    """Best combination per fold by the training folds, scored on the test fold.

    Counts of the training folds are the total minus the test fold, so every
    row is summed once and not once per fold.
    """
    rows = conf.join(folds.select("subject", "fold"), "subject")
    test = sum_confusion(rows, "fold", *parameters)
    total = sum_confusion(test, *parameters).withColumnsRenamed({c: f"_{c}" for c in COUNTS})
    joined = test.join(total, list(parameters))
    train = with_metrics(joined.select(
        "fold", *parameters, *[(F.col(f"_{c}") - F.col(c)).alias(c) for c in COUNTS],
        F.struct(*COUNTS).alias("_test")))
    best = best_row(train, metric, ["fold"], parameters)
    return with_metrics(best.select(
        "fold", *parameters, F.col(metric).alias(f"train_{metric}"), *[F.col(f"_test.{c}").alias(c) for c in COUNTS]))


def cross_validate(conf: DataFrame, subjects: DataFrame, order: Sequence[str], chunk: Column,
                   parameters: Sequence[str], folds: int = 10, test_share: float = 0.3, metric: str = "f1",
                   ) -> dict[str, DataFrame]:
    """``folds``, ``training`` (mean test-fold metrics) and ``test`` (held-out score of the best pick).

    ``subjects`` is ``(subject, cls, …)``. The overall pick is the fold winner
    with the best test-fold metric.
    """
    parts = positional_split(subjects, order, chunk, test_share)
    train = stratified_folds(parts.filter("part = 'train'"), order, chunk, folds)
    per_fold = fold_results(conf, train, parameters, metric)
    mean = per_fold.agg(*[F.avg(F.nanvl(F.col(m), F.lit(None).cast("double"))).alias(m) for m in METRICS])
    pick = best_row(per_fold, metric, [], ["fold"]).select(*parameters)
    held = conf.join(parts.filter("part = 'test'").select("subject"), "subject", "left_semi")
    scored = with_metrics(sum_confusion(held, *parameters)).join(pick, list(parameters))
    return {"folds": per_fold, "training": mean, "test": scored}
