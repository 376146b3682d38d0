"""Ordered computations that never put a whole subject into one task.

A window partitioned by subject gives a task all rows of that subject, which
does not hold once a single recording carries a large share of the data. The
helpers here cut the time axis into chunks (``idx div size``), work on each
``(subject, chunk)`` by itself, and settle what crosses a chunk border on a
table with a handful of rows per chunk.

* bounded frames: rows near a border are copied into the neighbouring chunk
  (``spread``), so a frame of fixed length always sees its rows;
* running totals: totals per chunk are accumulated and added as an offset
  (``running_total``, ``row_index``);
* runs of adjacent rows: only the first and the last run of a chunk can
  continue elsewhere, all others are final (``merge_runs``).

Where a calendar bounds the rows of a key, ``size`` may be None: a key is one
chunk, and rows that are in one task by their keys already are not moved.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNK = "_chunk"
OWN = "_own"
DEFAULT_SIZE = 65_536

Aggs = Mapping[str, tuple[str, str]]


def as_col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def div(a: str | Column, b: int | Column) -> Column:
    """Integer division (both sides non-negative)."""
    return F.call_function("div", as_col(a), b if isinstance(b, Column) else F.lit(b))


def settle(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spread the rows over tasks by (keys, chunk).

    Said explicitly, because rows that arrive hashed by subject alone (after a
    join on the subject, for instance) would already satisfy a window by
    (subject, chunk), and a large subject would stay in one task.
    """
    return df.repartition(*keys, CHUNK)


def with_chunk(df: DataFrame, keys: Sequence[str], idx: str, size: int | None) -> DataFrame:
    """Add the chunk of each row; rows that already carry it, or whose key is one chunk, are left where they are."""
    if CHUNK in df.columns:
        return df
    if size is None:
        return df.withColumn(CHUNK, F.lit(0).cast("long"))
    return settle(df.withColumn(CHUNK, div(idx, size)), keys)


def spread(df: DataFrame, keys: Sequence[str], idx: str, size: int | None, before: int, after: int) -> DataFrame:
    """Copy rows to every chunk holding a row whose frame ``[-before, +after]`` sees them.

    ``_own`` marks the copy in the row's own chunk; keep those after the window.
    """
    if size is None or (before <= 0 and after <= 0):
        return with_chunk(df, keys, idx, size).withColumn(OWN, F.lit(True))
    low = div(F.greatest(F.col(idx) - max(after, 0), F.lit(0)), size)
    high = div(F.col(idx) + max(before, 0), size)
    copies = df.withColumn(CHUNK, F.explode(F.sequence(low, high)))
    return settle(copies.withColumn(OWN, F.col(CHUNK) == div(idx, size)), keys)


def chunk_window(keys: Sequence[str], idx: str) -> W:
    return W.partitionBy(*keys, CHUNK).orderBy(idx)


def lagged_sum(running: str, offset: int, window) -> Column:
    """Running total ``offset`` rows earlier, 0 before the first row."""
    return F.coalesce(F.lag(running, offset).over(window), F.lit(0))


def leading_sum(running: str, offset: int, window, whole) -> Column:
    """Running total ``offset`` rows later, the final total past the last row."""
    return F.coalesce(F.lead(running, offset).over(window), F.max(running).over(whole))


def sliding_extremes(
    rows: DataFrame, keys: Sequence[str], idx: str, before: int, after: int, outputs: Mapping[str, tuple[str, str]],
) -> DataFrame:
    """Add minima and maxima of the row frame ``[-before, +after]`` inside the chunk, at the same cost for any length.

    ``outputs`` maps a column to ``(kind, source)`` with kind ``min`` or ``max``. A chunk is cut into pieces as long as
    the frame, so a frame is the end of one piece and the beginning of the next: its extreme is that of a running
    extreme from the piece's end at the first row and one from the piece's start at the last row. A frame that the
    chunk's border cuts short is the beginning of the first piece, or the end of the last one.
    """
    length = before + after + 1
    window, whole = chunk_window(keys, idx), W.partitionBy(*keys, CHUNK)
    kept = rows.columns
    rows = rows.withColumn("_piece", div(F.row_number().over(window) - 1, length))
    piece = W.partitionBy(*keys, CHUNK, "_piece")
    kinds = {"min": (F.min, F.least), "max": (F.max, F.greatest)}
    running = lambda out, order: kinds[outputs[out][0]][0](outputs[out][1]).over(
        piece.orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.select("*", *[running(out, F.desc(idx)).alias(f"_to_end_{out}") for out in outputs])
    rows = rows.select("*", *[running(out, F.asc(idx)).alias(f"_so_far_{out}") for out in outputs])
    first = F.lag("_piece", before).over(window)
    last = F.lead("_piece", after).over(window)
    at_end = window.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.select(
        "*", first.alias("_first"), last.alias("_last"), F.max("_piece").over(whole).alias("_end"),
        *[F.lag(f"_to_end_{out}", before).over(window).alias(f"_a_{out}") for out in outputs],
        *[F.lead(f"_so_far_{out}", after).over(window).alias(f"_b_{out}") for out in outputs],
        *[F.last(f"_so_far_{out}").over(at_end).alias(f"_e_{out}") for out in outputs])

    def extreme(out: str) -> Column:
        join = kinds[outputs[out][0]][1]
        a, b, end = (F.col(f"_{p}_{out}") for p in "abe")
        return (F.when(F.col("_first").isNull(), F.when(F.col("_last").isNull(), end).otherwise(b))
                .when(F.col("_last").isNotNull(), join(a, b))
                .when(F.col("_first") == F.col("_end"), a).otherwise(join(a, end)))

    return rows.select(*kept, *[extreme(out).alias(out) for out in outputs])


def join_per_key(rows: DataFrame, small: DataFrame, keys: Sequence[str], idx: str, size: int = DEFAULT_SIZE,
                 how: str = "inner") -> DataFrame:
    """Join a table with a few rows a key to one with very many, on (keys, chunk) in place of the keys alone.

    The few rows are copied to each chunk that their key has, so the rows of a large key stay spread over tasks. The
    chunks come from one aggregation over ``idx``, folded before the shuffle.
    """
    chunk = div(idx, size)
    chunks = rows.select(*keys, chunk.alias(CHUNK)).distinct()
    return rows.withColumn(CHUNK, chunk).join(small.join(chunks, list(keys)), [*keys, CHUNK], how).drop(CHUNK)


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a global aggregate (always exactly one row, hence broadcast)."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    chunk: Column,
    totals: Mapping[str, Column],
) -> DataFrame:
    """Add inclusive running totals of ``totals`` per key in ``order``.

    ``chunk`` must be monotone in ``order``. Two levels: inside a chunk, and
    over the chunk totals.
    """
    df = settle(df.withColumn(CHUNK, chunk), keys)
    for name, column in totals.items():
        df = df.withColumn(f"_v_{name}", column)
    inner = W.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = df.select("*", *[F.sum(f"_v_{n}").over(inner).alias(f"_r_{n}") for n in totals])
    outer = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, CHUNK)
        .agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in totals])
        .select(*keys, CHUNK, *[F.coalesce(F.sum(f"_t_{n}").over(outer), F.lit(0)).alias(f"_o_{n}") for n in totals])
    )
    joined = local.join(offsets, [*keys, CHUNK])
    for name in totals:
        joined = joined.withColumn(name, F.coalesce(F.col(f"_r_{name}"), F.lit(0)) + F.col(f"_o_{name}"))
    return joined.drop(CHUNK, *[f"_{p}_{n}" for n in totals for p in "vro"])


def row_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    chunk: Column,
    name: str,
) -> DataFrame:
    """0-based position per key in ``order`` (a two-level ``row_number() - 1``)."""
    df = settle(df.withColumn(CHUNK, chunk), keys)
    inner = W.partitionBy(*keys, CHUNK).orderBy(*order)
    outer = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, CHUNK)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, CHUNK, F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_off"))
    )
    return (
        df.withColumn("_rn", F.row_number().over(inner))
        .join(offsets, [*keys, CHUNK])
        .withColumn(name, F.col("_rn") - 1 + F.col("_off"))
        .drop("_rn", "_off", CHUNK)
    )


def _merge_agg(kind: str, source: str, start: str, stop: str) -> Column:
    if kind == "first":
        return F.min_by(source, start)
    if kind == "last":
        return F.max_by(source, stop)
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](source)


def merge_runs(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    stop: str,
    size: int = DEFAULT_SIZE,
    same: Sequence[str] = (),
    max_gap: int = 1,
    exact_gap: bool = False,
    aggs: Aggs | None = None,
) -> DataFrame:
    """Merge ordered, disjoint intervals whose neighbours are close and alike.

    Interval ``b`` joins its predecessor ``a`` when ``b.start - a.stop`` is at
    most ``max_gap`` (``exact_gap``: equal to it) and all ``same`` columns
    agree. ``aggs`` maps an output column to ``(kind, source)`` with kind one
    of sum, min, max, first, last. A row with ``start == stop`` is a sample.

    Runs are found inside chunks of ``start`` first; only the first and the
    last run of each chunk take part in the second pass.
    """
    aggs = dict(aggs or {})
    same = list(same)
    unit = with_chunk(df, keys, start, size).select(
        *keys, *same,
        F.col(start).alias("_start"), F.col(stop).alias("_stop"),
        *[F.col(src).alias(f"_in_{out}") for out, (_, src) in aggs.items()],
        CHUNK,
    )

    def breaks(window) -> Column:
        gap = F.col("_start") - F.lag("_stop").over(window)
        cond = (gap != max_gap) if exact_gap else (gap > max_gap)
        for name in same:
            cond = cond | (F.col(name) != F.lag(name).over(window))
        return F.coalesce(cond, F.lit(True)).cast("long")

    def fold(frame: DataFrame, group: Sequence[str]) -> DataFrame:
        return frame.groupBy(*group).agg(
            *[F.first(name).alias(name) for name in same],
            F.min("_start").alias("_lo"), F.max("_stop").alias("_hi"),
            *[_merge_agg(kind, f"_in_{out}", "_start", "_stop").alias(f"_out_{out}") for out, (kind, _) in aggs.items()],
        ).withColumnsRenamed({"_lo": "_start", "_hi": "_stop", **{f"_out_{o}": f"_in_{o}" for o in aggs}})

    inner = W.partitionBy(*keys, CHUNK).orderBy("_start")
    upto = inner.rowsBetween(W.unboundedPreceding, 0)
    local = unit.select("*", breaks(inner).alias("_brk"))
    runs = fold(local.select("*", F.sum("_brk").over(upto).alias("_run")), [*keys, CHUNK, "_run"])
    whole = W.partitionBy(*keys, CHUNK)
    edge = (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(whole))
    # Edge runs of all chunks of a key meet in one group, inner runs stay with their chunk.
    runs = runs.withColumn("_meet", F.when(edge, F.lit(-1).cast("long")).otherwise(F.col(CHUNK)))
    outer = W.partitionBy(*keys, "_meet").orderBy("_start")
    # A run that is not at an edge separates the edge runs around it.
    parted = (F.col(CHUNK) == F.lag(CHUNK).over(outer)) & (F.col("_run") - F.lag("_run").over(outer) > 1)
    runs = runs.select("*", F.when(parted, F.lit(1).cast("long")).otherwise(breaks(outer)).alias("_cut"))
    runs = runs.select("*", F.sum("_cut").over(outer.rowsBetween(W.unboundedPreceding, 0)).alias("_span"))
    merged = fold(runs, [*keys, "_meet", "_span"])
    return merged.select(
        *keys, *same, F.col("_start").alias(start), F.col("_stop").alias(stop),
        *[F.col(f"_in_{o}").alias(o) for o in aggs])


def _with_piece(rows: DataFrame, keys: Sequence[str], idx: str, closes: str) -> DataFrame:
    """Add ``_piece``: how many rows of the chunk close before this one."""
    before = chunk_window(keys, idx).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("_piece", F.coalesce(F.sum(F.col(closes).isNotNull().cast("long")).over(before), F.lit(0)))


def open_periods(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    opens: str,
    closes: str,
    size: int,
    close_at_end: bool,
) -> tuple[DataFrame, DataFrame]:
    """Number the pieces between closing rows and resolve pieces across chunks.

    ``opens`` holds the index of a row that may open a period (else null) and
    ``closes`` that of a row that ends one. A period runs from the first
    opening row after the previous close up to the next close. Returns the
    rows with their piece number and the table of border pieces
    ``(keys, chunk, _carry_open, _carry_close, _pieces)``.
    """
    rows = _with_piece(with_chunk(df, keys, idx, size), keys, idx, closes)
    per_piece = rows.groupBy(*keys, CHUNK, "_piece").agg(
        F.min(opens).alias("_open"), F.max(closes).alias("_close"), F.max(idx).alias("_last"))
    chunks = per_piece.groupBy(*keys, CHUNK).agg(
        F.sum(F.col("_close").isNotNull().cast("long")).alias("_pieces"),
        F.min("_close").alias("_first_close"),
        F.min(F.when(F.col("_piece") == 0, F.col("_open"))).alias("_first_open"),
        F.min(F.when(F.col("_close").isNull(), F.col("_open"))).alias("_tail_open"),
        F.max("_last").alias("_last"),
    )
    along = W.partitionBy(*keys).orderBy(CHUNK)
    against = W.partitionBy(*keys).orderBy(F.col(CHUNK).desc())
    chunks = chunks.withColumn(
        "_since", F.sum((F.col("_pieces") > 0).cast("long")).over(along.rowsBetween(W.unboundedPreceding, 0)))
    in_group = W.partitionBy(*keys, "_since").orderBy(CHUNK).rowsBetween(W.unboundedPreceding, 0)
    chunks = chunks.withColumn("_tail", F.min("_tail_open").over(in_group))
    # Walking backwards, the chunks already seen are the later ones.
    next_close = F.min("_first_close").over(against.rowsBetween(W.unboundedPreceding, -1))
    if close_at_end:
        next_close = F.coalesce(next_close, F.max("_last").over(W.partitionBy(*keys)))
    borders = chunks.select(
        *keys, CHUNK,
        F.coalesce(F.lag("_tail").over(along), F.col("_first_open")).alias("_carry_open"),
        next_close.alias("_carry_close"),
        F.col("_pieces"),
    )
    return rows, borders


def flag_periods(
    df: DataFrame, keys: Sequence[str], idx: str, opens: str, closes: str,
    min_length: int, size: int | None = DEFAULT_SIZE, close_at_end: bool = False, flag: str = "_inside",
) -> DataFrame:
    """Mark the rows inside periods of at least ``min_length`` rows."""
    piece = W.partitionBy(*keys, CHUNK, "_piece")
    if size is None:  # nothing is carried over a border, so the rows go through once
        rows = _with_piece(with_chunk(df, keys, idx, size), keys, idx, closes)
        # As below, rows without a key have no period before their first close, nor after their last.
        known = F.lit(True)
        for k in keys:
            known = known & F.col(k).isNotNull()
        last = F.max(closes).over(piece)
        if close_at_end:
            last = F.coalesce(last, F.when(known, F.max(idx).over(W.partitionBy(*keys, CHUNK))))
        joined = rows.withColumn("_s", F.when(known | (F.col("_piece") > 0), F.min(opens).over(piece))).withColumn("_e", last)
        first, last = F.col("_s"), F.col("_e")
    else:
        rows, borders = open_periods(df, keys, idx, opens, closes, size, close_at_end)
        rows = rows.withColumn("_s", F.min(opens).over(piece)).withColumn("_e", F.max(closes).over(piece))
        joined = rows.join(borders, [*keys, CHUNK], "left")
        first = F.when(F.col("_piece") == 0, F.col("_carry_open")).otherwise(F.col("_s"))
        last = F.when(F.col("_piece") == F.col("_pieces"), F.col("_carry_close")).otherwise(F.col("_e"))
    inside = (last - first >= min_length) & (F.col(idx) >= first) & (F.col(idx) < last)
    return joined.withColumn(flag, F.coalesce(inside, F.lit(False))).drop(
        "_piece", "_s", "_e", "_carry_open", "_carry_close", "_pieces", CHUNK)


def list_periods(
    df: DataFrame, keys: Sequence[str], idx: str, opens: str, closes: str,
    size: int = DEFAULT_SIZE, close_at_end: bool = False,
) -> DataFrame:
    """The periods themselves, ``(keys, start, stop)`` with ``stop`` exclusive.

    ``opens`` and ``closes`` may be any ordered type with the index first.
    Only the first and the unclosed piece of a chunk go to the second pass.
    """
    before = chunk_window(keys, idx).rowsBetween(W.unboundedPreceding, -1)
    rows = with_chunk(df, keys, idx, size).select(
        "*", F.coalesce(F.sum(F.col(closes).isNotNull().cast("long")).over(before), F.lit(0)).alias("_piece"))
    pieces = rows.groupBy(*keys, CHUNK, "_piece").agg(
        F.min(opens).alias("_s"), F.max(closes).alias("_e"), F.max(idx).alias("_last"))
    border = (F.col("_piece") == 0) | F.col("_e").isNull()
    pieces = pieces.select("*", F.when(border, F.lit(-1).cast("long")).otherwise(F.col(CHUNK)).alias("_meet"))
    along = W.partitionBy(*keys, "_meet").orderBy(CHUNK, "_piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select(
        "*", F.coalesce(F.sum(F.col("_e").isNotNull().cast("long")).over(along), F.lit(0)).alias("_period"))
    whole = pieces.groupBy(*keys, "_meet", "_period").agg(
        F.min("_s").alias("start"), F.max("_e").alias("stop"), F.max("_last").alias("_last"))
    stop = F.coalesce("stop", "_last") if close_at_end else F.col("stop")
    return whole.select(*keys, "start", stop.alias("stop")).filter(F.col("stop") > F.col("start"))
