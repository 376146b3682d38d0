"""Time axes, rate conversion by stride or repetition, and row selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stillwave.operators.chunked import as_col, div


def regular_time(start: str | Column, position: str | Column, period_sec: int) -> Column:
    """Time of the ``position``-th epoch after ``start``."""
    return F.timestamp_micros(F.unix_micros(as_col(start)) + as_col(position) * period_sec * 1_000_000)


def subsecond_time(sec: str | Column, position: str | Column, hz: int) -> Column:
    """Time of the ``position``-th sample of a second, on a millisecond grid."""
    if 1000 % hz:
        raise ValueError(f"{hz} Hz does not divide 1000 ms")
    return F.timestamp_millis(as_col(sec) * 1000 + as_col(position) * (1000 // hz))


def sample_time(start: str | Column, idx: str | Column, hz: int) -> Column:
    """Time of sample ``idx``; keep ``idx`` as the exact key where 1e6/hz is not whole."""
    if 1_000_000_000 % hz:
        raise ValueError(f"{hz} Hz does not divide 1e9 ns")
    micros = F.unix_micros(as_col(start))
    checked = F.when(micros % 1_000_000 != 0, F.raise_error(F.lit("start is not a whole second"))).otherwise(micros)
    return F.timestamp_micros(checked + div(as_col(idx) * 1_000_000, hz))


def explode_seconds(raw_seconds: DataFrame, hz: int, scale: str | Column | None = None) -> DataFrame:
    """One row per second with sample arrays -> one row per sample.

    ``idx`` is derived from time: seconds since the subject's first record
    times the rate, plus the position inside the second.
    """
    first = raw_seconds.groupBy("subject").agg(F.min("sec").alias("_first"))
    rows = raw_seconds.join(first, "subject").select(
        "subject", "sec", "_first", *([] if scale is None else [as_col(scale).alias("_scale")]),
        F.posexplode(F.arrays_zip("y", "x", "z")).alias("_pos", "_v"))
    unit = F.lit(1.0) if scale is None else F.col("_scale")
    return rows.select(
        "subject",
        ((F.col("sec") - F.col("_first")) * hz + F.col("_pos")).alias("idx"),
        subsecond_time("sec", "_pos", hz).alias("ts"),
        *[(F.col(f"_v.{a}") / unit).alias(a) for a in ("y", "x", "z")],
    )


def downsample(df: DataFrame, every: int, idx: str = "idx") -> DataFrame:
    """Every ``every``-th row, renumbered."""
    return df.filter(F.col(idx) % every == 0).withColumn(idx, div(idx, every))


def upsample(df: DataFrame, times: int, idx: str = "idx") -> DataFrame:
    """Repeat each row ``times`` times."""
    return (
        df.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
        .withColumn(idx, F.col(idx) * times + F.col("_rep")).drop("_rep")
    )


def slice_rows(df: DataFrame, start: int | None = None, stop: int | None = None, stride: int = 1,
               idx: str = "idx") -> DataFrame:
    """``[start, stop)`` with a stride counted from ``start``; bounds reach the scan as filters."""
    low = start or 0
    if start is not None:
        df = df.filter(F.col(idx) >= start)
    if stop is not None:
        df = df.filter(F.col(idx) < stop)
    return df if stride == 1 else df.filter((F.col(idx) - low) % stride == 0)


def exclude(df: DataFrame, unwanted: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Rows whose subject is not listed."""
    return df.join(unwanted.select(*keys).distinct(), list(keys), "left_anti")


def having(df: DataFrame, present: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Rows whose subject occurs in ``present``."""
    return df.join(present.select(*keys).distinct(), list(keys), "left_semi")


def subject_slice(subjects: DataFrame, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Subjects ``[skip:limit]`` in order; ``limit`` is an absolute end."""
    ordered = subjects.select("subject").distinct().orderBy("subject").offset(skip)
    return ordered if limit is None else ordered.limit(max(limit - skip, 0))
