"""Non-wear detectors. All emit ``wear``: 1 = worn, 0 = not worn.

The count-based methods (Hecht 2009, Troiano 2007, Choi 2011) need a dense
0-based epoch index per subject. The raw method (van Hees 2013) works on the
block table of :mod:`stillwave.operators.blocks`. ``size`` is that of
:mod:`stillwave.operators.chunked`, None where a calendar bounds the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stillwave.operators.blocks import AXES, pooled_std
from stillwave.operators.chunked import (
    CHUNK, DEFAULT_SIZE, OWN, chunk_window, div, flag_periods, lagged_sum, leading_sum, sliding_extremes, spread,
)

SUBJECT = ("subject",)


def _as_wear(condition: Column) -> Column:
    return F.when(condition, F.lit(0)).otherwise(F.lit(1)).cast("tinyint")


def quiet_window(interval_mins: float, epoch_sec: int) -> int:
    """Rows per interval; the interval must hold a whole number of epochs."""
    rows = interval_mins * 60 / epoch_sec
    if rows != int(rows):
        raise ValueError(f"{interval_mins} min is not a whole number of {epoch_sec} s epochs")
    return int(rows)


def neighbour_counts(
    df: DataFrame, active: Column, window_rows: int, idx: str = "epoch_idx",
    keys: Sequence[str] = SUBJECT, size: int | None = DEFAULT_SIZE,
) -> DataFrame:
    """Add ``following`` and ``preceding``: active rows in ``(i, i+W]`` and ``[i-W, i)``.

    Both come from one running count per chunk and two offset look-ups, so the
    cost per row does not grow with the window length.
    """
    rows = spread(df.withColumn("_active", active.cast("int")), keys, idx, size, window_rows, window_rows)
    window = chunk_window(keys, idx)
    whole = W.partitionBy(*keys, CHUNK)
    rows = rows.withColumn("_seen", F.sum("_active").over(window.rowsBetween(W.unboundedPreceding, 0)))
    return (
        rows.withColumn("following", leading_sum("_seen", window_rows, window, whole) - F.col("_seen"))
        .withColumn("preceding", lagged_sum("_seen", 1, window) - lagged_sum("_seen", window_rows + 1, window))
        .filter(OWN).drop(CHUNK, OWN, "_active", "_seen")
    )


def hecht(
    df: DataFrame, value: Column, epoch_sec: int = 60, threshold: float = 5,
    interval_mins: int = 20, min_count: int = 2, idx: str = "epoch_idx",
    keys: Sequence[str] = SUBJECT, size: int | None = DEFAULT_SIZE,
) -> DataFrame:
    """Hecht 2009 on the vector magnitude.

    A row above the threshold is non-wear when both sides are quiet, a row at
    or below it when one side is. A side is quiet when fewer than
    ``min_count`` rows of its interval exceed the threshold.
    """
    rows = quiet_window(interval_mins, epoch_sec)
    counted = neighbour_counts(df.withColumn("_value", value), F.col("_value") > threshold, rows, idx, keys, size)
    return (
        counted.withColumn("wear", _as_wear(hecht_support(threshold) < min_count))
        .drop("_value", "following", "preceding")
    )


def hecht_support(threshold: float | Column, value: str = "_value") -> Column:
    """Count that decides a row: it is non-wear for every ``min_count`` above it."""
    return F.when(F.col(value) > threshold, F.greatest("following", "preceding")).otherwise(
        F.least("following", "preceding"))


def troiano(
    df: DataFrame, value: Column, activity_threshold: float = 0, min_period_len: int = 60,
    spike_tolerance: int = 2, spike_stoplevel: float = 100, idx: str = "epoch_idx",
    keys: Sequence[str] = SUBJECT, size: int | None = DEFAULT_SIZE,
) -> DataFrame:
    """Troiano 2007.

    A period opens at a zero row and is closed by a row above the stop level,
    by the row that exceeds the tolerated number of consecutive spikes, or by
    the last row. The closing row is not part of the period.
    """
    window = chunk_window(keys, idx)
    tolerance = spike_tolerance
    rows = spread(df.withColumn("_value", value), keys, idx, size, tolerance + 1, 0)
    rows = rows.withColumn("_zero", F.col("_value") <= min(activity_threshold, spike_stoplevel))
    too_many = (
        (F.col("_value") > activity_threshold)
        & (F.sum((~F.col("_zero")).cast("int")).over(window.rowsBetween(-tolerance, 0)) == tolerance + 1)
        & F.coalesce(F.lag("_zero", tolerance + 1).over(window), F.lit(False))
    )
    closing = (F.col("_value") > spike_stoplevel) | too_many
    rows = (
        rows.withColumn("_closes", F.when(closing, F.col(idx)))
        .filter(OWN)
        .withColumn("_opens", F.when(F.col("_zero"), F.col(idx)))
    )
    flagged = flag_periods(rows, keys, idx, "_opens", "_closes", min_period_len, size, close_at_end=True)
    return flagged.withColumn("wear", _as_wear(F.col("_inside"))).drop(
        "_value", "_zero", "_opens", "_closes", "_inside", OWN)


#: Consecutive spikes that end a Choi period; fixed in the method, not a parameter.
CHOI_SPIKE_RUN = 3


def choi_window_counts(
    df: DataFrame, value: Column, spike_tolerance: int, min_window_len: int, idx: str,
    keys: Sequence[str], size: int | None, keep: bool = False,
) -> DataFrame:
    """Add ``_later`` and ``_earlier``: counts of non-zero rows around each row.

    Later rows are ``[i+tolerance, i+window]``, earlier rows ``[i-window, i-2]``.
    """
    reach = max(min_window_len, CHOI_SPIKE_RUN)
    rows = spread(df.withColumn("_value", value), keys, idx, size, reach, min_window_len)
    window = chunk_window(keys, idx)
    whole = W.partitionBy(*keys, CHUNK)
    rows = rows.withColumn("_seen", F.sum((F.col("_value") > 0).cast("int")).over(
        window.rowsBetween(W.unboundedPreceding, 0)))
    before_later = (
        lagged_sum("_seen", 1, window) if spike_tolerance == 0
        else leading_sum("_seen", spike_tolerance - 1, window, whole) if spike_tolerance > 1
        else F.col("_seen")
    )
    later = leading_sum("_seen", min_window_len, window, whole) - before_later
    earlier = lagged_sum("_seen", 2, window) - lagged_sum("_seen", min_window_len + 1, window)
    return rows.withColumn("_later", F.greatest(later, F.lit(0))).withColumn("_earlier", F.greatest(earlier, F.lit(0)))


def choi(
    df: DataFrame, value: Column, activity_threshold: float = 0, min_period_len: int = 90,
    spike_tolerance: int = 2, min_window_len: int = 30, window_spike_tolerance: int = 0,
    idx: str = "epoch_idx", keys: Sequence[str] = SUBJECT, size: int | None = DEFAULT_SIZE,
) -> DataFrame:
    """Choi 2011.

    A period opens at an exact zero. A non-zero row closes it when either
    neighbouring window holds more than ``window_spike_tolerance`` non-zero
    rows, or when it is the third in a row above the activity threshold. A
    period still open at the end of the recording is not reported.
    """
    window = chunk_window(keys, idx)
    rows = choi_window_counts(df, value, spike_tolerance, min_window_len, idx, keys, size)
    above = F.col("_value") > activity_threshold
    third = (
        (F.sum(above.cast("int")).over(window.rowsBetween(1 - CHOI_SPIKE_RUN, 0)) == CHOI_SPIKE_RUN)
        & F.coalesce(F.lag(~above, CHOI_SPIKE_RUN).over(window), F.lit(False))
    )
    crowded = (F.col("_value") > 0) & (
        (F.col("_later") > window_spike_tolerance) | (F.col("_earlier") > window_spike_tolerance))
    rows = (
        rows.withColumn("_closes", F.when(crowded | third, F.col(idx)))
        .filter(OWN)
        .withColumn("_opens", F.when(F.col("_value") == 0, F.col(idx)))
    )
    flagged = flag_periods(rows, keys, idx, "_opens", "_closes", min_period_len, size, close_at_end=False)
    return flagged.withColumn("wear", _as_wear(F.col("_inside"))).drop(
        "_value", "_seen", "_later", "_earlier", "_opens", "_closes", "_inside", OWN)


def hees_windows(
    blocks: DataFrame, window_blocks: int, window_rows: int, keys: Sequence[str] = SUBJECT,
    block: str = "block", size: int | None = DEFAULT_SIZE,
) -> DataFrame:
    """Pooled standard deviation and range of the window starting in each block.

    Adds ``full`` (the window has all its samples), ``std_<axis>`` and
    ``range_<axis>``. Sums come from running totals inside the chunk. The rows
    keep the chunk columns, with ``window_blocks - 1`` border rows on each
    side, so that the caller can look back over them.
    """
    rows = spread(blocks, keys, block, size, window_blocks - 1, window_blocks - 1)
    window = chunk_window(keys, block)
    whole = W.partitionBy(*keys, CHUNK)
    upto = window.rowsBetween(W.unboundedPreceding, 0)
    summed = ["n", *[f"sum_{a}" for a in AXES], *[f"sumsq_{a}" for a in AXES]]
    rows = rows.select("*", *[F.sum(c).over(upto).alias(f"_c_{c}") for c in summed])
    ends = {f"_{kind}_{a}": (kind, f"{kind}_{a}") for kind in ("min", "max") for a in AXES}
    rows = rows.select(
        *[c for c in rows.columns if not c.startswith("_c_")],
        *[(leading_sum(f"_c_{c}", window_blocks - 1, window, whole) - lagged_sum(f"_c_{c}", 1, window)).alias(f"_w_{c}")
          for c in summed])
    rows = rows.select(
        *[c for c in rows.columns if not c.startswith("_w_")], (F.col("_w_n") == window_rows).alias("full"),
        *[pooled_std("_w_n", f"_w_sum_{a}", f"_w_sumsq_{a}").alias(f"std_{a}") for a in AXES])
    ends = {f"_{kind}_{a}": (kind, f"{kind}_{a}") for kind in ("min", "max") for a in AXES}
    rows = sliding_extremes(rows, keys, block, 0, window_blocks - 1, ends)
    return rows.select(
        *[c for c in rows.columns if c not in ends],
        *[(F.col(f"_max_{a}") - F.col(f"_min_{a}")).alias(f"range_{a}") for a in AXES])


def axes_below(prefix: str, threshold: float | Column, strict: bool = True) -> Column:
    """How many axes have ``<prefix>_<axis>`` below the threshold."""
    total = F.lit(0)
    for axis in AXES:
        c = F.col(f"{prefix}_{axis}")
        total = total + F.coalesce(((c < threshold) if strict else (c <= threshold)).cast("int"), F.lit(0))
    return total


def _covered_by_quiet(rows: DataFrame, quiet: Column, window_blocks: int, keys: Sequence[str], block: str) -> DataFrame:
    """Add ``wear``: 0 where any of the windows that cover the block is quiet, by running counts."""
    window = chunk_window(keys, block)
    upto = window.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_quiet", F.sum(F.coalesce(quiet, F.lit(False)).cast("int")).over(upto))
    covering = F.col("_quiet") - lagged_sum("_quiet", window_blocks, window)
    return rows.withColumn("wear", _as_wear(covering > 0))


def hees_blocks(
    blocks: DataFrame, step_rows: int, window_blocks: int, std_threshold: float, std_min_axes: int,
    range_threshold: float, range_min_axes: int, keys: Sequence[str] = SUBJECT,
    block: str = "block", size: int | None = DEFAULT_SIZE,
) -> DataFrame:
    """van Hees 2013 on a block table whose blocks are one step long.

    A window of ``window_blocks`` blocks is non-wear when enough axes have a
    small standard deviation or a small range; a block is non-wear when any
    window covering it is. Thresholds are strict and in g.
    """
    rows = hees_windows(blocks, window_blocks, window_blocks * step_rows, keys, block, size)
    quiet = F.col("full") & (
        (axes_below("std", std_threshold) >= std_min_axes)
        | (axes_below("range", range_threshold) >= range_min_axes))
    return (
        _covered_by_quiet(rows, quiet, window_blocks, keys, block)
        .filter(OWN).drop(CHUNK, OWN, "_quiet", "full", *[f"{p}_{a}" for p in ("std", "range") for a in AXES])
    )


def hees(
    signal: DataFrame, hz: int = 100, window_mins: int = 60, step_mins: int = 15,
    std_mg: float = 3.0, std_min_axes: int = 2, range_mg: float = 50.0, range_min_axes: int = 2,
    idx: str = "idx", keys: Sequence[str] = SUBJECT, size: int | None = DEFAULT_SIZE, samples_per_min: int | None = None,
) -> DataFrame:
    """van Hees 2013 on raw samples; returns ``(keys, block, wear)`` per step block.

    A window that is not a multiple of the step is handled by using their
    greatest common divisor as block length.
    """
    from math import gcd

    from stillwave.operators.blocks import block_stats

    per_min = samples_per_min or hz * 60
    step, length = step_mins * per_min, window_mins * per_min
    unit = gcd(step, length)
    blocks = block_stats(signal, unit, idx=idx, keys=keys)
    if unit == step:
        return hees_blocks(blocks, step, length // step, std_mg / 1000, std_min_axes,
                           range_mg / 1000, range_min_axes, keys, "block", size)
    return hees_blocks_uneven(blocks, unit, step // unit, length // unit, std_mg / 1000, std_min_axes,
                              range_mg / 1000, range_min_axes, keys, size)


def hees_blocks_uneven(
    blocks: DataFrame, unit_rows: int, step_blocks: int, window_blocks: int, std_threshold: float,
    std_min_axes: int, range_threshold: float, range_min_axes: int,
    keys: Sequence[str] = SUBJECT, size: int | None = DEFAULT_SIZE,
) -> DataFrame:
    """As ``hees_blocks`` for windows starting only at every ``step_blocks``-th block."""
    rows = hees_windows(blocks, window_blocks, window_blocks * unit_rows, keys, "block", size)
    starts_here = F.col("block") % step_blocks == 0
    quiet = starts_here & F.col("full") & (
        (axes_below("std", std_threshold) >= std_min_axes)
        | (axes_below("range", range_threshold) >= range_min_axes))
    return (
        _covered_by_quiet(rows, quiet, window_blocks, keys, "block")
        .filter(OWN).drop(CHUNK, OWN, "_quiet", "full", *[f"{p}_{a}" for p in ("std", "range") for a in AXES])
    )


def expand_blocks(samples: DataFrame, blocks: DataFrame, block_rows: int, idx: str = "idx",
                  keys: Sequence[str] = SUBJECT, columns: Sequence[str] = ("wear",)) -> DataFrame:
    """Bring per-block columns back to the samples (equi-join on the block number)."""
    keyed = samples.withColumn("block", div(idx, block_rows))
    return keyed.join(blocks.select(*keys, "block", *columns), [*keys, "block"], "left").drop("block")
