"""Detectors over all subjects at once, from stored epochs to stored labels."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from stillwave.functions.expressions import vector_magnitude
from stillwave.operators import detectors as D
from stillwave.operators.axes import exclude
from stillwave.operators.epochs import COUNTS, crop, reindex_from_start, roll_up

Detector = Callable[[DataFrame], DataFrame]


def detect_counts(epochs: DataFrame, detectors: Mapping[str, Detector]) -> DataFrame:
    """Add one non-wear column (1 = not worn) per detector.

    Detectors pass the rows through, so several of them need no join.
    """
    for name, detector in detectors.items():
        epochs = detector(epochs).withColumn(name, (1 - F.col("wear")).cast("int")).drop("wear")
    return epochs


def published_detectors(epoch_sec: int = 60) -> dict[str, Detector]:
    """The three count-based methods with their published parameters."""
    return {
        "hecht": lambda df: D.hecht(df, vector_magnitude("axis1", "axis2", "axis3"), epoch_sec=epoch_sec),
        "troiano": lambda df: D.troiano(df, F.col("axis1")),
        "choi": lambda df: D.choi(df, F.col("axis1")),
    }


def prepare_epochs(epochs: DataFrame, limits: DataFrame, from_sec: int = 10, to_sec: int = 60,
                   invalid: DataFrame | None = None, columns: Sequence[str] = COUNTS) -> DataFrame:
    """Valid subjects' epochs at the detector's length, cropped to the recording and numbered from 0."""
    if invalid is not None:
        epochs = exclude(epochs, invalid)
    return reindex_from_start(crop(roll_up(epochs, from_sec, to_sec, columns), limits), to_sec)


def detect_all(epochs: DataFrame, limits: DataFrame, from_sec: int = 10, to_sec: int = 60,
               invalid: DataFrame | None = None, detectors: Mapping[str, Detector] | None = None) -> DataFrame:
    """``(subject, epoch_idx, ts, <method>...)`` for every subject with epochs and bounds."""
    ready = prepare_epochs(epochs, limits, from_sec, to_sec, invalid)
    chosen = detectors or published_detectors(to_sec)
    return detect_counts(ready, chosen).select("subject", "epoch_idx", "ts", *chosen)
