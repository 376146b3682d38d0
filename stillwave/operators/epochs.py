"""Epoch tables: roll-up to longer epochs and cropping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from stillwave.operators.chunked import div

COUNTS = ("axis1", "axis2", "axis3", "steps")


def roll_up(
    epochs: DataFrame, from_sec: int, to_sec: int, columns: Sequence[str] = COUNTS,
    keys: Sequence[str] = ("subject",), ts: str | None = "ts",
) -> DataFrame:
    """Sum consecutive epochs into longer ones; an incomplete last group is dropped."""
    return roll_up_many(epochs, from_sec, [to_sec], columns, keys, ts)


def roll_up_many(
    epochs: DataFrame, from_sec: int, to_secs: Sequence[int], columns: Sequence[str] = COUNTS,
    keys: Sequence[str] = ("subject",), ts: str | None = "ts",
) -> DataFrame:
    """All target epoch lengths in one pass, told apart by ``epoch_sec``."""
    for to_sec in to_secs:
        if to_sec % from_sec:
            raise ValueError(f"{to_sec} s is not a multiple of {from_sec} s")
    ratios = F.explode(F.array(*[F.lit(t // from_sec) for t in to_secs]))
    rows = epochs.drop("epoch_sec").withColumn("_ratio", ratios)
    aggs = [F.sum(c).alias(c) for c in columns]
    if ts:
        aggs.append(F.min(ts).alias(ts))
    return (
        rows.groupBy(*keys, "_ratio", div("epoch_idx", F.col("_ratio")).alias("epoch_idx"))
        .agg(F.count(F.lit(1)).alias("_n"), *aggs)
        .filter(F.col("_n") == F.col("_ratio"))
        .withColumn("epoch_sec", (F.col("_ratio") * from_sec).cast("int"))
        .drop("_n", "_ratio")
    )


def bounds(signal: DataFrame, keys: Sequence[str] = ("subject",), ts: str = "ts") -> DataFrame:
    """First and last time per subject."""
    return signal.groupBy(*keys).agg(F.min(ts).alias("start"), F.max(ts).alias("stop"))


def crop(df: DataFrame, limits: DataFrame, keys: Sequence[str] = ("subject",), ts: str = "ts") -> DataFrame:
    """Rows within ``[start, stop]`` of their subject; subjects without limits go."""
    return (
        df.join(limits.select(*keys, "start", "stop"), list(keys))
        .filter(F.col(ts).between(F.col("start"), F.col("stop")))
        .drop("start", "stop")
    )


def reindex_from_start(df: DataFrame, epoch_sec: int, keys: Sequence[str] = ("subject",), ts: str = "ts") -> DataFrame:
    """Make ``epoch_idx`` count from the subject's first remaining epoch."""
    first = df.groupBy(*keys).agg(F.min("epoch_idx").alias("_first"))
    return df.join(first, list(keys)).withColumn("epoch_idx", F.col("epoch_idx") - F.col("_first")).drop("_first")
