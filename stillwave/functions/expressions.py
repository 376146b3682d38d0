"""Scalar column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stillwave.functions.fixed_values import DATE_FORMATS, LONG_LABELS, SIGNIFICANCE_MARKS
from stillwave.operators.chunked import as_col


def vector_magnitude(*axes: str | Column, minus_one: bool = False, clip: bool = False) -> Column:
    """Euclidean norm; ``minus_one`` subtracts gravity, ``clip`` floors at zero."""
    total = None
    for axis in axes:
        c = as_col(axis).cast("double")
        total = c * c if total is None else total + c * c
    out = F.sqrt(total)
    if minus_one:
        out = out - F.lit(1.0)
    return F.greatest(out, F.lit(0.0)) if clip else out


def rescale(value: str | Column, scale: str | Column) -> Column:
    """Raw counts to g."""
    return as_col(value) / as_col(scale)


def min_max_scale(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("subject",), low: float = -1.0,
                  high: float = 1.0) -> DataFrame:
    """Scale columns to ``[low, high]`` per key; a constant column gives null.

    The bounds are an aggregate joined back, not a window over all rows.
    """
    bounds = df.groupBy(*keys).agg(
        *[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns])
    joined = df.join(bounds, list(keys))
    for c in columns:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        joined = joined.withColumn(c, F.try_divide((high - low) * (F.col(c) - lo), hi - lo) + low)
    return joined.drop(*[f"_{p}_{c}" for p in ("lo", "hi") for c in columns])


WEIGHTS = ("t_y", "t_x", "t_z", "b_y", "b_x", "b_z")


def parse_weights(meta: str | Column) -> list[Column]:
    """Calibration weights out of a metadata map, identity where absent."""
    meta = as_col(meta)
    return [
        F.coalesce(F.try_element_at(meta, F.lit(w)).try_cast("double"), F.lit(1.0 if w.startswith("t") else 0.0)).alias(w)
        for w in WEIGHTS
    ]


def calibrate(signal: DataFrame, weights: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """``value * t + b`` per axis; subjects without weights stay unchanged."""
    joined = signal.join(weights.select(*keys, *WEIGHTS), list(keys), "left")
    for a in ("y", "x", "z"):
        joined = joined.withColumn(
            a, F.col(a) * F.coalesce(F.col(f"t_{a}"), F.lit(1.0)) + F.coalesce(F.col(f"b_{a}"), F.lit(0.0)))
    return joined.drop(*WEIGHTS)


def parse_start(date: str | Column, time: str | Column, date_format: str | Column) -> Column:
    """Start timestamp from header texts; an unknown format or value gives null."""
    text = F.concat_ws(" ", as_col(date), as_col(time))
    out = F.lit(None).cast("timestamp")
    for label, pattern in DATE_FORMATS.items():
        out = F.when(as_col(date_format) == label, F.try_to_timestamp(text, F.lit(f"{pattern} HH:mm:ss"))).otherwise(out)
    return out


def decode_map(column: str | Column) -> Column:
    """Byte values of a map as text."""
    return F.transform_values(as_col(column), lambda _, v: F.decode(v, "UTF-8"))


def flip(label: str | Column) -> Column:
    return F.lit(1) - as_col(label)


def bmi(weight_kg: str | Column, height_cm: str | Column) -> Column:
    metres = as_col(height_cm) / 100
    return as_col(weight_kg) / (metres * metres)


def sex_label(code: str | Column) -> Column:
    return F.when(as_col(code).cast("string") == "1", "Male").otherwise("Female")


def long_label(code: str | Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in LONG_LABELS.items() for x in pair])
    return F.try_element_at(lookup, as_col(code))


def significance(p: str | Column) -> Column:
    out = F.lit("")
    for limit, mark in sorted(SIGNIFICANCE_MARKS.items(), reverse=True):
        out = F.when(as_col(p) < limit, mark).otherwise(out)
    return out


def parameter_key(*columns: str | Column) -> Column:
    """Hyphen-joined parameter key."""
    return F.concat_ws("-", *[as_col(c).cast("string") for c in columns])


def split_key(key: str | Column, names: Sequence[str], separator: str = "-") -> list[Column]:
    """Named parts of a joined key."""
    parts = F.split(as_col(key), separator)
    return [F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)]


def signal_to_noise(mean: Column, std: Column) -> Column:
    return F.when(std == 0, F.lit(0.0)).otherwise(mean / std)


def in_daytime(ts: str | Column, start: str = "07:00:00", stop: str = "23:00:00") -> Column:
    """Time of day within ``[start, stop]``, both ends included."""
    return F.date_format(as_col(ts), "HH:mm:ss").between(start, stop)


def moving_average(df: DataFrame, value: str, n: int, idx: str = "idx", keys: Sequence[str] = ("subject",),
                   size: int = 65_536, name: str = "moving_avg") -> DataFrame:
    """Mean of ``n`` rows starting at each row, full frames only."""
    from stillwave.operators.chunked import CHUNK, OWN, chunk_window, spread

    rows = spread(df, keys, idx, size, 0, n - 1)
    frame = chunk_window(keys, idx).rowsBetween(0, n - 1)
    return (
        rows.withColumn(name, F.avg(value).over(frame)).withColumn("_n", F.count(F.lit(1)).over(frame))
        .filter(F.col(OWN) & (F.col("_n") == n)).drop(CHUNK, OWN, "_n")
    )
