"""Overlay of run-length label sets: what any number of labellings say, without a row for each second.

A label set is reduced to its change points where it is made (``change_points``), scaled to a common clock (``scaled``)
and laid over the others (``overlay``) by a sweep: the points of all sets are ordered by time, each set's label is
carried on from its last point, and the time to the next point is the weight of the label vector. Rows that are
shuffled after the first step are change points, however long the recordings are. The sweep is cut into chunks of time;
a table with one row for each subject and chunk settles what is carried across their borders.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stillwave.operators.chunked import CHUNK, DEFAULT_SIZE, as_col, chunk_window, div, settle, with_chunk
from stillwave.session import stash

SUBJECT = ("subject",)
DAY = 86_400


def change_points(
    labels: DataFrame, names: Sequence[str], idx: str = "idx", keys: Sequence[str] = SUBJECT, size: int | None = DEFAULT_SIZE,
) -> DataFrame:
    """``(keys, at, upto, names)``: rows whose labels differ from the row before, with the index after the last row seen.

    Labels of one table are looked at together, in one pass. The first and the last row of a chunk stay too, so that no
    row has to be compared across a border; a point where nothing changes does no harm.
    """
    window = chunk_window(keys, idx)
    rows = with_chunk(labels.select(*keys, idx, *names, *([CHUNK] if CHUNK in labels.columns else [])), keys, idx, size)
    kept = F.lag(idx).over(window).isNull() | F.lead(idx).over(window).isNull()
    for name in names:
        kept = kept | ~F.col(name).eqNullSafe(F.lag(name).over(window))
    return rows.withColumn("_kept", kept).filter("_kept").select(
        *keys, F.col(idx).alias("at"), (F.col(idx) + 1).alias("upto"), *names)


def scaled(points: DataFrame, repeat: int = 1, every: int = 1) -> DataFrame:
    """Points on a clock with ``repeat`` ticks for each row, or one tick for each ``every`` rows (that row's label).

    Of several points in one tick the last one counts, which ``_raw`` tells.
    """
    up = lambda c: div(F.col(c) * repeat + (every - 1), every).alias(c)
    return points.select("*").withColumns({"_raw": F.col("at"), "at": up("at"), "upto": up("upto")})


def overlay(
    sets: Mapping[str, DataFrame], keys: Sequence[str] = SUBJECT, size: int = DEFAULT_SIZE,
) -> DataFrame:
    """``(keys, start, stop, <labels of all sets>)``: disjoint half-open ranges with one label vector each.

    ``sets`` are scaled change points by name, each with one or more label columns. A subject's ranges end with its
    shortest set; subjects that lack a set are left out, as is the time before all sets have a label.
    """
    own = {name: [c for c in df.columns if c not in (*keys, "at", "upto", "_raw")] for name, df in sets.items()}
    stacked = None
    for name, df in sets.items():
        raw = "_raw" if "_raw" in df.columns else "at"
        row = df.select(*keys, "at", *[
            (F.struct(F.col(raw).alias("raw"), *own[other], F.col("upto").alias("upto")) if other == name
             else F.lit(None).cast(_point_type(sets[other], own[other]))).alias(f"_p_{other}") for other in sets])
        stacked = row if stacked is None else stacked.unionByName(row)
    # The last point of each set at each time, made once; then everything by chunks of time.
    points = stacked.groupBy(*keys, "at").agg(*[F.max(f"_p_{n}").alias(f"_p_{n}") for n in sets])
    # Rows without a key have no range; left out here, both readers below share one shuffle.
    points = stash(points.withColumn(CHUNK, div("at", size)))
    points = settle(points.filter(_all_given([F.col(c) for c in (*keys, CHUNK)])), keys)

    last = lambda n: F.max_by(f"_p_{n}", F.when(F.col(f"_p_{n}").isNotNull(), F.col("at")))
    chunks = points.groupBy(*keys, CHUNK).agg(
        F.min("at").alias("_first"), *[last(n).alias(f"_l_{n}") for n in sets],
        *[F.max(f"_p_{n}.upto").alias(f"_u_{n}") for n in sets])
    along = W.partitionBy(*keys).orderBy(CHUNK)
    whole = W.partitionBy(*keys)
    ends = [F.max(f"_u_{n}").over(whole) for n in sets]
    clip = F.when(_all_given(ends), F.least(*ends) if len(ends) > 1 else ends[0])
    borders = chunks.select(
        *keys, CHUNK, F.lead("_first").over(along).alias("_next"), clip.alias("_clip"),
        *[F.last(f"_l_{n}", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1)).alias(f"_c_{n}") for n in sets])

    inner = chunk_window(keys, "at")
    upto = inner.rowsBetween(W.unboundedPreceding, 0)
    local = points.select(
        *keys, CHUNK, "at", F.lead("at").over(inner).alias("_after"),
        *[F.last(f"_p_{n}", ignorenulls=True).over(upto).alias(f"_p_{n}") for n in sets])
    joined = local.join(borders, [*keys, CHUNK]).select(
        *keys, F.col("at").alias("start"), F.least(F.coalesce("_after", "_next", "_clip"), F.col("_clip")).alias("stop"),
        *[F.coalesce(f"_p_{n}", f"_c_{n}").alias(f"_p_{n}") for n in sets])
    given = _all_given([F.col(f"_p_{n}") for n in sets])
    return joined.filter(given & (F.col("stop") > F.col("start"))).select(
        *keys, "start", "stop", *[F.col(f"_p_{n}.{c}").alias(c) for n in sets for c in own[n]])


def _point_type(df: DataFrame, names: Sequence[str]) -> str:
    fields = ["raw bigint", *[f"{c} {df.schema[c].dataType.simpleString()}" for c in names], "upto bigint"]
    return f"struct<{','.join(f.replace(' ', ':', 1) for f in fields)}>"


def _all_given(columns: Sequence[Column]) -> Column:
    given = F.lit(True)
    for c in columns:
        given = given & c.isNotNull()
    return given


def ticks_of_day(start: Column, stop: Column, first: int, last: int, day: int = DAY) -> Column:
    """How many ticks of ``[start, stop)`` have a time of day in ``[first, last]``, both ends included."""
    length = last - first + 1

    def before(x: Column) -> Column:
        within = F.greatest(F.least(F.pmod(x, F.lit(day)) - first, F.lit(length)), F.lit(0))
        return F.floor(x / day) * length + within

    return (before(stop) - before(start)).cast("long")


def vector_counts(ranges: DataFrame, names: Sequence[str], keys: Sequence[str] = SUBJECT) -> DataFrame:
    """Ticks of each label vector, ``(keys, names, n)``."""
    return ranges.groupBy(*keys, *names).agg(F.sum(F.col("stop") - F.col("start")).alias("n"))


def per_tick(ranges: DataFrame, name: str = "sec") -> DataFrame:
    """The label table with one row for each tick, for those who need it in full."""
    ticks = F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias(name)
    return ranges.select(*[c for c in ranges.columns if c not in ("start", "stop")], ticks)


def weighted_variants(
    ranges: DataFrame, started: str | Column, first: int = 7 * 3600, last: int = 23 * 3600, day: int = DAY,
) -> DataFrame:
    """Each range once for the whole day and once for daytime, with the ticks it counts, as ``variant`` and ``n``.

    ``started`` is the tick of the day at which the subject's clock starts.
    """
    shift = as_col(started)
    daytime = ticks_of_day(F.col("start") + shift, F.col("stop") + shift, first, last, day)
    both = F.array(F.struct(F.lit("all").alias("variant"), (F.col("stop") - F.col("start")).alias("n")),
                   F.struct(F.lit("daytime").alias("variant"), daytime.alias("n")))
    rest = [c for c in ranges.columns if c not in ("start", "stop")]
    return ranges.select(*rest, F.explode(both).alias("_v")).select(*rest, "_v.variant", "_v.n").filter("n > 0")
