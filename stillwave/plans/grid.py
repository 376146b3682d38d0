"""Exhaustive parameter searches: confusion counts per subject and combination.

No detector runs once per combination. Each plan finds what the parameters
really change and shares the rest:

* Hecht: a row is non-wear for every minimum count above one number, so a
  chunk's rows collapse to a histogram of that number for each window;
* Troiano, Choi: a chunk's rows are scanned once for all combinations together,
  and a period counts for every minimum length up to its own;
* van Hees: a block only needs the k-th smallest spread over its windows; a
  chunk's blocks are counted for all thresholds together.

Epoch input: ``(subject, epoch_idx, axis1, vmu, truth)`` with ``truth`` 1 for
non-wear. Counts are in rows; multiply by the row length for seconds.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from stillwave.operators.align import with_parameters
from stillwave.operators.blocks import AXES
from stillwave.operators.chunked import (
    CHUNK, DEFAULT_SIZE, OWN, chunk_window, div, list_periods, settle, spread,
)
from stillwave.operators.detectors import CHOI_SPIKE_RUN
from stillwave.session import cut_lineage

SUBJECT = ("subject",)
Space = Mapping[str, Sequence]


def combinations(space: Space) -> list[dict]:
    """All combinations of a parameter space."""
    return [dict(zip(space, values)) for values in product(*space.values())]


def subject_totals(epochs: DataFrame, keys: Sequence[str] = SUBJECT) -> DataFrame:
    return epochs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("truth").alias("_t")).filter("_n > 0")


def confusion_of(marked: DataFrame, totals: DataFrame, space: Space, keys: Sequence[str] = SUBJECT) -> DataFrame:
    """tn, fp, fn, tp from rows marked (``_pred``) and rightly marked (``tp``) per combination.

    Combinations without any marked row come from the parameter side.
    """
    names = list(space)
    every = with_parameters(totals, space)
    return _confusion(every.join(marked, [*keys, *names], "left").na.fill(0, ["_pred", "tp"]), [*keys, *names])


def _confusion(joined: DataFrame, kept: Sequence[str]) -> DataFrame:
    return joined.select(
        *kept,
        (F.col("_n") - F.col("_pred") - F.col("_t") + F.col("tp")).cast("long").alias("tn"),
        (F.col("_pred") - F.col("tp")).cast("long").alias("fp"),
        (F.col("_t") - F.col("tp")).cast("long").alias("fn"),
        F.col("tp").cast("long").alias("tp"))


def _at_least(counted: DataFrame, level: str, thresholds: Sequence, name: str, keys: Sequence[str]) -> DataFrame:
    """Spread a row whose ``level`` is k over the first k thresholds and add up."""
    values = F.array(*[F.lit(v) for v in thresholds])
    return (
        counted.filter(F.col(level) > 0)
        .withColumn(name, F.explode(F.slice(values, 1, F.col(level))))
        .groupBy(*keys, name).agg(F.sum("_pred").alias("_pred"), F.sum("tp").alias("tp"))
    )


def hecht_grid(epochs: DataFrame, space: Space, epoch_sec: int = 60, keys: Sequence[str] = SUBJECT,
               size: int = DEFAULT_SIZE, by: Sequence[str] | None = None) -> DataFrame:
    """Confusion per subject and (t, i, m); per ``by`` in place of the subject, if given.

    A chunk of rows goes through once, for all combinations together, and leaves one row with two counts for each
    combination. Those of a subject are added up in one place, where its total is too.
    """
    from stillwave.operators.detectors import quiet_window

    by = keys if by is None else by
    names = {n: list(space[n]) for n in ("t", "i", "m")}
    windows = [quiet_window(i, epoch_sec) for i in names["i"]]
    reach = max(windows)
    # Rows without a key mark nothing, whatever the counts are added up by.
    known = epochs.select(*keys, "epoch_idx", F.col("vmu").cast("double").alias("_value"),
                          F.col("truth").cast("long").alias("truth")).dropna(subset=list(keys))
    rows = spread(known, keys, "epoch_idx", size, reach, reach)
    found = rows.groupBy(*keys, CHUNK).applyInArrow(
        _hecht_counts(keys, names["t"], windows, names["m"]), _packed_schema(rows, keys))
    totals = subject_totals(epochs, by)
    if set(by) == set(keys):
        return _packed_confusion(found, totals, names, keys)
    cells = F.posexplode(F.arrays_zip(F.col("_preds").alias("_pred"), F.col("_tps").alias("tp"))).alias("_combo", "_c")
    marked = found.select(*by, cells).groupBy(*by, "_combo").agg(
        F.sum("_c._pred").alias("_pred"), F.sum("_c.tp").alias("tp"))
    marked = marked.select(*by, *_values_of("_combo", names), "_pred", "tp")
    return confusion_of(marked, totals, {k: space[k] for k in names}, by)


def _packed_confusion(found: DataFrame, totals: DataFrame, names: Mapping[str, Sequence], keys: Sequence[str]) -> DataFrame:
    """tn, fp, fn, tp from rows with the counts of all combinations, ``_preds`` and ``_tps``.

    Each subject is one packed row until its total is beside it.
    """
    zeros = F.array_repeat(F.lit(0).cast("long"), int(np.prod([len(v) for v in names.values()])))
    add = lambda c: F.aggregate(F.collect_list(c), zeros, lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias(c)
    packed = totals.join(found.groupBy(*keys).agg(add("_preds"), add("_tps")), list(keys), "left")
    cells = F.posexplode(F.arrays_zip(F.coalesce("_preds", zeros).alias("_pred"), F.coalesce("_tps", zeros).alias("tp")))
    each = packed.select(*keys, "_n", "_t", cells.alias("_combo", "_c")).select(
        *keys, "_n", "_t", *_values_of("_combo", names), F.col("_c._pred").alias("_pred"), F.col("_c.tp").alias("tp"))
    return _confusion(each, [*keys, *names])


def _packed_row(table: pa.Table, keys: Sequence[str], preds: np.ndarray, tps: np.ndarray) -> pa.Table:
    row = pa.table({k: table.column(k).slice(0, 1) for k in keys})
    for c, out in (("_preds", preds), ("_tps", tps)):
        row = row.append_column(c, pa.array([out.ravel()], pa.list_(pa.int64())))
    return row


def _packed_schema(rows: DataFrame, keys: Sequence[str]) -> T.StructType:
    return T.StructType([*[rows.schema[k] for k in keys], *[
        T.StructField(c, T.ArrayType(T.LongType())) for c in ("_preds", "_tps")]])


def _hecht_counts(keys: Sequence[str], thresholds: Sequence, windows: Sequence[int], minimums: Sequence):
    """Rows that a chunk marks, and rightly marks, for each threshold, window and minimum.

    A row is marked for every minimum above its support, so supports are counted by the number of minimums above them.
    """
    limits, ordered, reach = np.array(thresholds, float), np.sort(minimums), max(windows)
    above = len(ordered) - np.searchsorted(ordered, np.arange(reach + 1), side="right")
    levels = len(ordered) + 1
    # Of the sorted minimums the j-th is above the supports with at least ``len - j`` minimums above them.
    picked = len(ordered) - np.searchsorted(ordered, minimums)
    first = np.arange(0, len(limits) * levels, levels)[:, None]  # the cells of a threshold

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("epoch_idx")
        own = np.flatnonzero(table.column(OWN).to_numpy())
        shape = (len(limits), levels)
        preds, tps = np.zeros((2, len(limits), len(windows), len(picked)), np.int64)
        if not len(own):
            return _packed_row(table, keys, preds, tps)
        v = pc.fill_null(table.column("_value"), -np.inf).to_numpy()
        busy = (v > limits[:, None]) | np.isnan(v)
        seen = np.zeros((len(limits), len(v) + 1 + 2 * reach), np.int32)
        np.cumsum(busy, axis=1, out=seen[:, reach + 1:reach + 1 + len(v)])
        seen[:, reach + 1 + len(v):] = seen[:, reach + len(v), None]
        a, b = reach + own[0], reach + own[-1] + 1  # a chunk's own rows follow each other
        busy = busy[:, own[0]:own[-1] + 1]
        truth = pc.fill_null(table.column("truth"), 0).to_numpy()[own[0]:own[-1] + 1]
        weight = np.broadcast_to(truth.astype(float), busy.shape).ravel()
        for i, w in enumerate(windows):
            following = seen[:, a + 1 + w:b + 1 + w] - seen[:, a + 1:b + 1]
            preceding = seen[:, a:b] - seen[:, a - w:b - w]
            support = np.where(busy, np.maximum(following, preceding), np.minimum(following, preceding))
            cell = (above.take(support) + first).ravel()
            for out, weights in ((preds, None), (tps, weight)):
                found = np.bincount(cell, weights, len(limits) * levels).reshape(shape)
                out[:, i] = found[:, ::-1].cumsum(axis=1)[:, ::-1][:, picked]
        return _packed_row(table, keys, preds, tps)

    return count


def _values_of(combo: str, names: Mapping[str, Sequence]) -> list[Column]:
    """The values of a combination's number, the last name's changing first."""
    out, rest = [], int(np.prod([len(v) for v in names.values()]))
    for n, values in names.items():
        rest //= len(values)
        out.append(F.element_at(F.array(*[F.lit(v) for v in values]), (div(combo, rest) % len(values) + 1).cast("int")).alias(n))
    return out


def _with_truth_position(epochs: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Add ``_p``: true non-wear rows before this one, and whether the row's chunk is the first or the last of its key."""
    rows = settle(epochs.select(
        *keys, "epoch_idx", "axis1", "vmu", F.col("truth").cast("long").alias("truth")).withColumn(CHUNK, div("epoch_idx", size)), keys)
    along = W.partitionBy(*keys).orderBy(CHUNK)
    offsets = rows.groupBy(*keys, CHUNK).agg(F.sum("truth").alias("_t")).select(
        *keys, CHUNK, F.coalesce(F.sum("_t").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"),
        F.lag(CHUNK).over(along).isNull().alias("_first"), F.lead(CHUNK).over(along).isNull().alias("_last"))
    upto = chunk_window(keys, "epoch_idx").rowsBetween(W.unboundedPreceding, 0)
    return rows.select("*", F.sum("truth").over(upto).alias("_r")).join(offsets, [*keys, CHUNK]).select(
        *keys, "epoch_idx", "axis1", "vmu", (F.col("_r") + F.col("_o") - F.col("truth")).alias("_p"), "_first", "_last")


#: Bits for the truth position in a packed spot; row numbers use the bits above.
SPOT_BITS = 31


def _row(spot: str) -> Column:
    return F.shiftright(F.col(spot), SPOT_BITS)


def _hits(spot: str) -> Column:
    return F.col(spot).bitwiseAND(F.lit((1 << SPOT_BITS) - 1))


#: Rows of a chunk whose marks are made at a time: a bit for each row and combination.
ROWS_AT_A_TIME = 1024
#: Opens and closes ``(rows, combinations)`` of the rows from one position up to another.
Marks = Callable[[int, int], tuple[np.ndarray, np.ndarray]]


def _scan(spots: np.ndarray, own: np.ndarray, marks: Marks, lengths: np.ndarray, width: int, first: bool, last: bool,
          close_at_end: bool) -> tuple[np.ndarray, np.ndarray, list]:
    """The periods of one chunk, for all combinations in one pass over its rows.

    Gives rows and hits ``(combination, level)`` of the periods that are settled here, and the events
    ``(combinations, spots, closes)`` that concern other chunks: the first opening and the first close if a chunk
    precedes, the last opening if one follows.
    """
    rows, hits = np.zeros((2, width, len(lengths) + 1), np.int64)
    opened, settled = np.full(width, -1, np.int64), np.full(width, first)
    events, before = [], np.zeros(width, bool)
    mask, every, end = (1 << SPOT_BITS) - 1, np.flatnonzero(own), None
    for lo in range(0, len(every), ROWS_AT_A_TIME):
        start, stop = every[lo], every[min(lo + ROWS_AT_A_TIME, len(every)) - 1] + 1
        opens, closes = marks(start, stop)
        if close_at_end and last and stop == every[-1] + 1:
            closes = closes.copy()
            closes[-1] = True
        # A row that opens like the one before it changes nothing.
        fresh = opens & ~np.concatenate([before[None, :], opens[:-1]])
        before = opens[-1]
        closing = closes.any(axis=1)
        for r in np.flatnonzero(closing | fresh.any(axis=1)):
            spot = spots[start + r]
            if closing[r]:
                shut = closes[r]
                done = np.flatnonzero(shut & settled & (opened >= 0))
                long = (spot >> SPOT_BITS) - (opened[done] >> SPOT_BITS)
                level = np.searchsorted(lengths, long, side="right")
                rows[done, level] += long
                hits[done, level] += (spot & mask) - (opened[done] & mask)
                if not settled.all():
                    begun = np.flatnonzero(shut & ~settled & (opened >= 0))
                    events.append((begun, opened[begun], False))
                    ended = np.flatnonzero(shut & ~settled)
                    events.append((ended, np.full(len(ended), spot), True))
                    settled |= shut
                opened[shut] = -1
            opened[fresh[r] & (opened < 0)] = spot
    if not last:
        left = np.flatnonzero(opened >= 0)
        events.append((left, opened[left], False))
    return rows, hits, events


def _score_chunks(rows: DataFrame, keys: Sequence[str], by: Sequence[str], names: Mapping[str, Sequence], vm: Sequence[bool],
                  lengths: Sequence[int], marks_of: Callable[[np.ndarray], Marks], close_at_end: bool, totals: DataFrame,
                  space: Space, size: int) -> DataFrame:
    """Periods of all combinations, then their rows and hits for every minimum length.

    A chunk of rows (with the copies its frames need) goes through once, for all combinations of ``names``. Only
    subjects of more than one chunk have events left; those go by ``list_periods``.
    """
    lengths = sorted(lengths)
    steps, width = np.array(lengths), int(np.prod([len(v) for v in names.values()]))
    kept = T.StructType([rows.schema[k] for k in keys])
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in [
        ("vm", T.BooleanType()), ("_combo", T.IntegerType()), ("_level", T.IntegerType()), ("_pred", T.LongType()),
        ("tp", T.LongType()), ("epoch_idx", T.LongType()), ("opens", T.LongType()), ("closes", T.LongType())]]])

    def score(table: pa.Table) -> pa.Table:
        table = table.sort_by("epoch_idx")
        column = lambda c: table.column(c).to_numpy()
        own = column(OWN)
        spots = (column("epoch_idx").astype(np.int64) << SPOT_BITS) + column("_p")
        at = int(own.argmax())
        flag = lambda c: table.column(c)[at].as_py()
        out = {c: [] for c in ("vm", "_combo", "_level", "_pred", "tp", "spot", "closes")}

        def add(count: int, **values) -> None:
            for c, v in values.items():
                out[c].append(np.broadcast_to(np.asarray(v, np.int64), count))

        for use in vm if own.any() else ():
            marks = marks_of(column("vmu" if use else "axis1"))
            length, hit, events = _scan(spots, own, marks, steps, width, flag("_first"), flag("_last"), close_at_end)
            combo, level = np.nonzero(length[:, 1:])
            add(len(combo), vm=use, _combo=combo, _level=level + 1, _pred=length[combo, level + 1], tp=hit[combo, level + 1],
                spot=0, closes=0)
            for which, spot, closes in events:
                add(len(which), vm=use, _combo=which, _level=0, _pred=0, tp=0, spot=spot, closes=closes)
        done = {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()}
        event, closes = done["_level"] == 0, done["closes"] == 1
        n = len(event)
        return pa.table({
            **{k: pa.repeat(table.column(k)[0], n) for k in keys}, "vm": pa.array(done["vm"] == 1),
            "_combo": pa.array(done["_combo"].astype(np.int32)), "_level": pa.array(done["_level"].astype(np.int32), mask=event),
            "_pred": pa.array(done["_pred"], mask=event), "tp": pa.array(done["tp"], mask=event),
            "epoch_idx": pa.array(done["spot"] >> SPOT_BITS, mask=~event),
            "opens": pa.array(done["spot"], mask=~event | closes), "closes": pa.array(done["spot"], mask=~event | ~closes)})

    found = rows.groupBy(*keys, CHUNK).applyInArrow(score, schema)
    # What is settled is added up without the keys that are not asked for; the frame is read twice, for both kinds of rows.
    found = found.select(*[k if k in by else F.when(F.col("_level").isNull(), F.col(k)).alias(k) for k in keys],
                         *[f.name for f in schema if f.name not in keys])
    found = cut_lineage(found.groupBy(*keys, "vm", "_combo", "_level", "epoch_idx", "opens", "closes").agg(
        F.sum("_pred").alias("_pred"), F.sum("tp").alias("tp")))
    events = found.filter("_level IS NULL").select(*keys, "vm", "_combo", "epoch_idx", "opens", "closes")
    periods = list_periods(events, [*keys, "vm", "_combo"], "epoch_idx", "opens", "closes", size)
    length = _row("stop") - _row("start")
    level = F.lit(0)
    for m in lengths:
        level = level + (length >= m).cast("int")
    across = periods.select(*by, "vm", "_combo", level.alias("_level"), length.alias("_pred"),
                            (_hits("stop") - _hits("start")).alias("tp"))
    counted = found.filter("_level IS NOT NULL").select(*across.columns).unionByName(across).groupBy(
        *by, "vm", "_combo", "_level").agg(F.sum("_pred").alias("_pred"), F.sum("tp").alias("tp"))
    counted = counted.select("*", *_values_of("_combo", names))
    marked = _at_least(counted, "_level", lengths, "mpl", [*by, *names, "vm"])
    return confusion_of(marked, totals, space, by)


def troiano_grid(epochs: DataFrame, space: Space, keys: Sequence[str] = SUBJECT, size: int = DEFAULT_SIZE,
                 by: Sequence[str] | None = None) -> DataFrame:
    """Confusion per subject and (at, mpl, st, ss, vm); per ``by`` in place of the subject, if given."""
    by = keys if by is None else by
    names = {n: list(space[n]) for n in ("at", "st", "ss")}
    at, st, ss = (x.ravel() for x in np.meshgrid(*names.values(), indexing="ij"))
    levels, which = np.unique(np.minimum(at, ss), return_inverse=True)

    def marks_of(value: np.ndarray) -> Marks:
        number = np.arange(1, len(value) + 1)[:, None]
        busy = value[:, None] > levels
        place = number - np.maximum.accumulate(np.where(busy, 0, number), axis=0)  # in its run of busy rows, from 1

        def marks(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
            return ~busy[lo:hi, which], (value[lo:hi, None] > ss) | (place[lo:hi, which] == st + 1)
        return marks

    rows = spread(_with_truth_position(epochs, keys, size), keys, "epoch_idx", size, int(st.max()) + 1, 0)
    return _score_chunks(rows, keys, by, names, space["vm"], space["mpl"], marks_of, True, subject_totals(epochs, by),
                         {k: space[k] for k in ("at", "mpl", "st", "ss", "vm")}, size)


def choi_grid(epochs: DataFrame, space: Space, keys: Sequence[str] = SUBJECT, size: int = DEFAULT_SIZE,
              by: Sequence[str] | None = None) -> DataFrame:
    """Confusion per subject and (at, mpl, st, mwl, wst, vm); per ``by`` in place of the subject, if given."""
    by = keys if by is None else by
    names = {n: list(space[n]) for n in ("at", "st", "mwl", "wst")}
    thresholds, tolerances, windows = (np.array(names[n]) for n in ("at", "st", "mwl"))
    which = [x.ravel() for x in np.meshgrid(*[np.arange(len(v)) for v in names.values()], indexing="ij")]
    third_of, crowd_of, allowed = which[0], which[1] * len(windows) + which[2], np.array(names["wst"])[which[3]]

    def marks_of(value: np.ndarray) -> Marks:
        busy, i = value > 0, np.arange(len(value))
        seen = np.cumsum(busy)
        ahead = lambda k: seen[np.minimum(i + k, len(i) - 1)]
        back = lambda k: np.where(i >= k, seen[np.maximum(i - k, 0)], 0)
        crowd = np.stack([np.maximum(ahead(w) - (back(1) if t == 0 else ahead(t - 1)), back(2) - back(w + 1))
                          for t in tolerances for w in windows], axis=1)
        over = value[:, None] > thresholds
        third = np.zeros_like(over)
        run = np.ones_like(over[CHOI_SPIKE_RUN:])
        for k in range(CHOI_SPIKE_RUN):
            run = run & over[CHOI_SPIKE_RUN - k:len(over) - k]
        third[CHOI_SPIKE_RUN:] = run & ~over[:-CHOI_SPIKE_RUN]

        def marks(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
            closes = (busy[lo:hi, None] & (crowd[lo:hi, crowd_of] > allowed)) | third[lo:hi, third_of]
            return np.broadcast_to(~busy[lo:hi, None], closes.shape), closes
        return marks

    reach = max(max(space["mwl"]), CHOI_SPIKE_RUN)
    rows = spread(_with_truth_position(epochs, keys, size), keys, "epoch_idx", size, reach, max(space["mwl"]))
    return _score_chunks(rows, keys, by, names, space["vm"], space["mpl"], marks_of, False, subject_totals(epochs, by),
                         {k: space[k] for k in ("at", "mpl", "st", "mwl", "wst", "vm")}, size)


def hees_grid(blocks: DataFrame, block_truth: DataFrame | None, space: Space, block_rows: int,
              keys: Sequence[str] = SUBJECT, size: int | None = DEFAULT_SIZE) -> DataFrame:
    """Confusion per subject and (mw, wo, st, sa, vt, va), with blocks of one step.

    ``space["wo"]`` is the step the blocks were made with; ``mw`` is in the
    same unit. ``block_truth`` is ``(keys, block, n, truth)``: rows and true
    non-wear rows per block; None if the blocks themselves have ``truth``. A
    chunk of blocks goes through once, for all combinations together, and
    leaves one row.
    """
    step = space["wo"][0]
    if len(space["wo"]) != 1 or any(w % step for w in space["mw"]):
        raise ValueError("one step, and windows that are multiples of it")
    counts = lambda df: df.agg(F.sum("n").alias("_rows"), F.sum("truth").cast("long").alias("truth"))
    reach = max(space["mw"]) // step - 1
    summed = [f"{p}_{a}" for p in ("sum", "sumsq") for a in AXES]
    ends = [f"{p}_{a}" for p in ("min", "max") for a in AXES]
    values = [F.col(c).cast("double").alias(c) for c in (*summed, *ends)]
    if block_truth is None:
        known = blocks.select(*keys, "block", "n", *values, F.col("n").alias("_rows"), F.col("truth").cast("long").alias("truth"))
    else:
        # A block without truth still belongs to the windows around it.
        known = blocks.select(*keys, "block", "n", *values).join(counts(block_truth.groupBy(*keys, "block")), [*keys, "block"], "left")
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    rows = spread(known, keys, "block", size, reach, reach)
    found = rows.groupBy(*keys, CHUNK).applyInArrow(_hees_counts(keys, space, step, block_rows), _packed_schema(rows, keys))
    totals = counts((blocks if block_truth is None else block_truth).groupBy(*keys)).withColumnsRenamed({"_rows": "_n", "truth": "_t"})
    return _packed_confusion(found, totals, {k: list(space[k]) for k in ("mw", "wo", "st", "sa", "vt", "va")}, keys)


def _extremes(values: np.ndarray, length: int, best: Callable) -> np.ndarray:
    """``best`` of each row and the ``length - 1`` rows after it, or those that there are; lengths cost a logarithm."""
    reach = 1
    while 2 * reach <= length:
        values = np.concatenate([best(values[:, :-reach], values[:, reach:]), values[:, -reach:]], axis=1) if (
            reach < values.shape[1]) else values
        reach *= 2
    rest = length - reach
    if 0 < rest < values.shape[1]:
        values = np.concatenate([best(values[:, :-rest], values[:, rest:]), values[:, -rest:]], axis=1)
    return values


def _hees_counts(keys: Sequence[str], space: Space, step: int, block_rows: int):
    """Rows that a chunk of blocks marks, and rightly marks, for each combination.

    A block is marked when the quietest of the windows over it is below the standard deviation or the range, on as many
    axes as asked for: the k-th smallest of the axes decides for k axes.
    """
    stds, ranges = (np.array([t / 1000 for t in space[c]]) for c in ("st", "vt"))
    # Thresholds in order; where those of the space are among them.
    limits = [(np.sort(v), np.searchsorted(np.sort(v), v)) for v in (stds, ranges)]

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        own = table.column(OWN).to_numpy()
        take = lambda p, none: np.stack([pc.fill_null(table.column(f"{p}_{a}"), none).to_numpy() for a in AXES])
        before = lambda x: np.concatenate([np.zeros((len(x), 1), x.dtype), np.cumsum(x, axis=1)], axis=1)
        n, total, squares = before(table.column("n").to_numpy()[None]), before(take("sum", 0.0)), before(take("sumsq", 0.0))
        low, high = take("min", np.inf), take("max", -np.inf)
        weights = [pc.fill_null(table.column(c), 0).to_numpy()[own].astype(float) for c in ("_rows", "truth")]
        shape = [len(space[c]) for c in ("mw", "wo", "st", "sa", "vt", "va")]
        out = np.zeros((2, *shape), np.int64)
        for m, mw in enumerate(space["mw"]):
            w = mw // step
            first = np.arange(len(own))
            last = np.minimum(first + w, len(own))
            over = lambda c: c[:, last] - c[:, first]
            count, s, q = over(n), over(total), over(squares)
            with np.errstate(invalid="ignore", divide="ignore"):
                std = np.sqrt(np.maximum(count * q - s * s, 0.0)) / count
                spread_of = _extremes(high, w, np.maximum) - _extremes(low, w, np.fmin)
            spread_of[np.isinf(spread_of)] = np.nan
            marks = []
            for values, (order, _) in zip((std, spread_of), limits):
                kth = np.sort(values, axis=0)
                kth[np.isnan(kth) | (count != w * block_rows)] = np.inf
                # The windows over a block begin at it or before it.
                least = _extremes(kth[:, ::-1], w, np.minimum)[:, ::-1][:, own]
                marks.append(np.searchsorted(order, least, side="right"))
            deep = len(ranges) + 1
            for i, sa in enumerate(space["sa"]):
                for j, va in enumerate(space["va"]):
                    cell = marks[0][sa - 1] * deep + marks[1][va - 1]
                    for counts, weight in zip(out, weights):
                        held = np.bincount(cell, weight, (len(stds) + 1) * deep).reshape(-1, deep)
                        # Threshold number k is above a value with at most k thresholds at or below it.
                        loud = held[::-1, ::-1].cumsum(axis=0).cumsum(axis=1)[::-1, ::-1]
                        at = np.ix_(limits[0][1] + 1, limits[1][1] + 1)
                        counts[m, 0, :, i, :, j] = held.sum() - loud[at]
        return _packed_row(table, keys, *out)

    return count


def best_row(df: DataFrame, metric: str, keys: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """The row with the highest metric per key; ties go to the smallest ``ties`` values.

    A min/max aggregate, so it combines map-side.
    """
    rank = F.struct((-F.coalesce(F.col(metric), F.lit(-1.0))).alias("_r"), *[F.col(t) for t in ties])
    columns = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), rank).alias("_best"))
    return best.select(*keys, "_best.*")


def best_with_ties(df: DataFrame, metric: str, keys: Sequence[str] = ()) -> DataFrame:
    """All rows that share the highest metric of their key."""
    top = df.groupBy(*keys).agg(F.max(metric).alias(metric))
    return df.join(top, [*keys, metric], "left_semi")


def tied_ranges(df: DataFrame, metric: str, parameters: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Best metric per key and, per parameter, ``min--max`` over the tied rows (or the single value)."""
    tied = best_with_ties(df, metric, keys)
    text = lambda p: F.when(F.min(p) != F.max(p), F.concat(F.min(p).cast("string"), F.lit("--"), F.max(p).cast("string"))
                            ).otherwise(F.min(p).cast("string")).alias(p)
    return tied.groupBy(*keys).agg(F.max(metric).alias(metric), *[text(p) for p in parameters])


def surfaces(results: DataFrame, space: Space, fixed: Mapping[str, object], metric: str,
             skip: Sequence[str] = (), skip_pairs: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Metric over each pair of parameters, the others fixed: ``(pair, p1, v1, p2, v2, metric)``."""
    names = [n for n in space if n not in skip]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:] if (a, b) not in skip_pairs]
    options = []
    for a, b in pairs:
        others = F.lit(True)
        for n in space:
            if n not in (a, b):
                others = others & (F.col(n) == F.lit(fixed[n]))
        options.append(F.when(others, F.struct(
            F.lit(f"{a}_{b}").alias("pair"), F.col(a).cast("string").alias("v1"), F.col(b).cast("string").alias("v2"))))
    return (
        results.withColumn("_s", F.explode(F.array(*options))).filter("_s IS NOT NULL")
        .select("_s.pair", "_s.v1", "_s.v2", metric)
    )
