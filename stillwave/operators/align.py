"""Joins on time: device alignment, range joins, tolerance matches, timelines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from stillwave.operators.chunked import CHUNK, DEFAULT_SIZE, div

SUBJECT = ("subject",)


def device_bounds(a: DataFrame, b: DataFrame, keys: Sequence[str] = SUBJECT, ts: str = "ts") -> DataFrame:
    """Common span ``[start, stop)`` of two devices per subject.

    The start is that of device A when device B has a sample at that time,
    else that of B; the end is B's last time cut to the second. Subjects
    without overlap or without either device are left out.
    """
    first = a.groupBy(*keys).agg(F.min(ts).alias("a_start"))
    span = b.groupBy(*keys).agg(F.min(ts).alias("b_start"), F.max(ts).alias("_b_stop"))
    both = first.join(span, list(keys)).withColumn("stop", F.date_trunc("second", "_b_stop"))
    both = both.filter(F.col("stop") >= F.col("a_start"))
    # Device B meets one row per subject on (subject, time); only the hits are made distinct.
    shared = (
        b.select(*keys, F.col(ts).alias("a_start")).join(both.select(*keys, "a_start"), [*keys, "a_start"])
        .select(*keys).distinct().withColumn("_shared", F.lit(True))
    )
    return both.join(shared, list(keys), "left").select(
        *keys, F.when(F.col("_shared"), F.col("a_start")).otherwise(F.col("b_start")).alias("start"), "stop")


def slice_to(df: DataFrame, limits: DataFrame, keys: Sequence[str] = SUBJECT, ts: str = "ts") -> DataFrame:
    """Rows in ``[start, stop)`` of their subject (end excluded)."""
    return (
        df.join(limits, list(keys)).filter((F.col(ts) >= F.col("start")) & (F.col(ts) < F.col("stop")))
        .drop("start", "stop")
    )


def align_devices(a: DataFrame, b: DataFrame, others: Mapping[str, DataFrame] | None = None,
                  keys: Sequence[str] = SUBJECT) -> dict[str, DataFrame]:
    """All signals of both devices cut to their common span."""
    limits = device_bounds(a, b, keys)
    return {name: slice_to(df, limits, keys) for name, df in {"a": a, "b": b, **(others or {})}.items()}


def samples_in_episodes(
    samples: DataFrame, episodes: DataFrame, idx: str = "idx", start: str = "start_index",
    stop: str = "stop_index", closed: bool = True, keys: Sequence[str] = SUBJECT, block_rows: int = 4096,
) -> DataFrame:
    """Samples with the episode they lie in, ``[start, stop]`` or ``[start, stop)``.

    Episodes are expanded to block numbers; both sides meet on (subject, block).
    """
    last = F.col(stop) if closed else F.col(stop) - 1
    wide = episodes.filter(last >= F.col(start)).withColumn(
        "_block", F.explode(F.sequence(div(start, block_rows), div(last, block_rows))))
    joined = samples.withColumn("_block", div(idx, block_rows)).join(wide, [*keys, "_block"])
    upper = (F.col(idx) <= F.col(stop)) if closed else (F.col(idx) < F.col(stop))
    return joined.filter((F.col(idx) >= F.col(start)) & upper).drop("_block")


def near_true(candidates: DataFrame, truth: DataFrame, window: int = 10, idx: str = "idx",
              keys: Sequence[str] = SUBJECT) -> DataFrame:
    """Add ``is_true``: the candidate lies in ``[t - window/2, t + window/2 - 1]`` of a true index."""
    half = window // 2
    reach = (
        truth.select(*keys, F.explode(F.sequence(F.col(idx) - half, F.col(idx) - half + window - 1)).alias(idx))
        .distinct().withColumn("_hit", F.lit(True))
    )
    return (
        candidates.join(reach, [*keys, idx], "left")
        .withColumn("is_true", F.coalesce("_hit", F.lit(False)).cast("int")).drop("_hit")
    )


def outer_timeline(parts: Mapping[str, DataFrame], on: Sequence[str] = ("subject", "ts")) -> DataFrame:
    """Full outer join of any number of one-value-per-time tables.

    One union and one aggregation: a single shuffle however many parts.
    """
    stacked = None
    for name, df in parts.items():
        row = df.select(*on, *[(F.col("value") if n == name else F.lit(None).cast(parts[n].schema["value"].dataType)).alias(n)
                               for n in parts])
        stacked = row if stacked is None else stacked.unionByName(row)
    return stacked.groupBy(*on).agg(*[F.max(n).alias(n) for n in parts])


def segment_signals(a: DataFrame, b: DataFrame, heart: DataFrame, keys: Sequence[str] = (*SUBJECT, "idx")) -> DataFrame:
    """Rows where both magnitudes and the heart rate exist at the same index."""
    return a.join(b, list(keys)).join(heart, list(keys))


def edge_windows(
    signal: DataFrame, episodes: DataFrame, rows: int, idx: str = "idx", axes: Sequence[str] = ("y", "x", "z"),
    keys: Sequence[str] = SUBJECT, size: int = DEFAULT_SIZE,
) -> DataFrame:
    """The ``rows`` samples before the start and from the stop of each episode.

    Windows that are not complete are left out. A window is a sorted array,
    bounded by its fixed length. Samples meet the edges of their chunk, and
    those of the next chunk's beginning, so they are shuffled once.
    """
    carried = [c for c in episodes.columns if c not in ("start_index", "stop_index")]
    spans = episodes.select(*carried, F.explode(F.array(
        F.struct(F.lit("start").alias("side"), (F.col("start_index") - rows).alias("_a")),
        F.struct(F.lit("stop").alias("side"), F.col("stop_index").alias("_a")))).alias("_s")).select(
        *carried, "_s.side", "_s._a").filter("_a >= 0").dropna(subset=list(keys)).withColumn(CHUNK, div("_a", size))
    group = [*keys, CHUNK]
    chunks = F.sequence(div(F.greatest(F.col(idx) - rows + 1, F.lit(0)), size), div(idx, size))
    near = signal.select(*keys, idx, *axes, F.explode(chunks).alias(CHUNK)).join(
        spans.select(*group).distinct(), group, "left_semi")
    names = [*carried, "side"]

    def cut(edges: pa.Table, samples: pa.Table) -> pa.Table:
        samples = samples.sort_by([(c, "ascending") for c in (idx, *axes)]).combine_chunks()
        at, first = samples.column(idx).to_numpy(), edges.column("_a").to_numpy()
        low = np.searchsorted(at, first)
        whole = np.searchsorted(at, first + rows) - low == rows
        taken = samples.select(list(axes)).take(pa.array((low[whole, None] + np.arange(rows)).reshape(-1)))
        window = pa.StructArray.from_arrays([taken.column(a).combine_chunks() for a in axes], names=list(axes))
        ends = pa.array(np.arange(whole.sum() + 1, dtype=np.int32) * rows)
        return edges.select(names).filter(pa.array(whole)).append_column("w", pa.ListArray.from_arrays(ends, window))

    schema = T.StructType([*spans.select(*names).schema.fields, T.StructField("w", T.ArrayType(T.StructType(
        [T.StructField(a, signal.schema[a].dataType) for a in axes])))])
    return spans.groupBy(*group).cogroup(near.groupBy(*group)).applyInArrow(cut, schema)


def fixed_windows(
    joined: DataFrame, rows: int, columns: Sequence[str], idx: str = "idx", start: str = "start_index",
    keys: Sequence[str] = (*SUBJECT, "counter", "label"),
) -> DataFrame:
    """Complete windows of ``rows`` samples inside each episode, remainder dropped."""
    return (
        joined.groupBy(*keys, div(F.col(idx) - F.col(start), rows).alias("win"))
        .agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list(F.struct(idx, *columns))).alias("w"))
        .filter(F.col("_n") == rows).drop("_n")
        .withColumn("w", F.transform("w", lambda s: F.struct(*[s[c].alias(c) for c in columns])))
    )


def with_parameters(df: DataFrame, space: Mapping[str, Sequence]) -> DataFrame:
    """Each row once per parameter combination (a generator, not a join)."""
    for name, values in space.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def label_matrix(truth: DataFrame, predictions: Mapping[str, DataFrame], on: Sequence[str] = ("subject", "sec")) -> DataFrame:
    """Truth and predictions side by side where all of them exist."""
    out = truth.select(*on, F.col("nw").alias("truth"))
    for name, df in predictions.items():
        out = out.join(df.select(*on, F.col("nw").alias(name)), list(on))
    return out
