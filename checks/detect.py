"""Detectors, windows, episodes and raw segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, r6, s6
from checks.tables import EPOCHS_SQL, MINUTE, SIGNAL_SQL
from stillwave.functions.expressions import moving_average
from stillwave.functions.metrics import confusion, with_metrics
from stillwave.operators import blocks as B, detectors as D, episodes as E, segments as S
from stillwave.operators.chunked import OWN, sliding_extremes, spread

HECHT = dict(threshold=5, interval_mins=20, min_count=1)
TROIANO = dict(activity_threshold=0, min_period_len=24, spike_tolerance=1, spike_stoplevel=20)
CHOI = dict(activity_threshold=0, min_period_len=12, spike_tolerance=2, min_window_len=6, window_spike_tolerance=1)
HOUR = 3600

W_ALL = "PARTITION BY subject ORDER BY epoch_idx"


def hecht_sql(source="epochs", t=5, w=20, m=1):
    return f"""
  SELECT *, CASE WHEN vmu > {t}
      THEN CASE WHEN f >= {m} OR p >= {m} THEN 1 ELSE 0 END
      ELSE CASE WHEN f >= {m} AND p >= {m} THEN 1 ELSE 0 END END AS wear
  FROM (SELECT *, count(*) FILTER (vmu > {t}) OVER ({W_ALL} ROWS BETWEEN 1 FOLLOWING AND {w} FOLLOWING) AS f,
      count(*) FILTER (vmu > {t}) OVER ({W_ALL} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS p FROM {source})"""


def period_sql(flags, opening, closing, mpl, closes_at_end):
    """Detector skeleton over ``flags``: running groups between closing rows."""
    end = " OR epoch_idx = last_idx" if closes_at_end else ""
    return f"""
  SELECT *, CASE WHEN s IS NOT NULL AND e IS NOT NULL AND e - s >= {mpl} AND epoch_idx >= s AND epoch_idx < e
                 THEN 0 ELSE 1 END AS wear
  FROM (SELECT *, min(CASE WHEN {opening} THEN epoch_idx END) OVER (PARTITION BY subject, g) AS s,
               max(CASE WHEN trm THEN epoch_idx END) OVER (PARTITION BY subject, g) AS e
        FROM (SELECT *, coalesce(sum(CASE WHEN trm THEN 1 ELSE 0 END) OVER ({W_ALL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g
              FROM (SELECT *, ({closing}{end}) AS trm FROM ({flags}))))"""


def troiano_sql(source="epochs", v="axis1", at=0, mpl=24, tol=1, ss=20):
    low = min(at, ss)
    flags = f"""
    SELECT *, row_number() OVER (PARTITION BY subject, zrun ORDER BY epoch_idx) - CASE WHEN zrun > 0 THEN 1 ELSE 0 END AS rp
    FROM (SELECT *, sum(CASE WHEN {v} <= {low} THEN 1 ELSE 0 END) OVER ({W_ALL}) AS zrun,
                 max(epoch_idx) OVER (PARTITION BY subject) AS last_idx FROM {source})"""
    return period_sql(flags, f"{v} <= {low}", f"{v} > {ss} OR ({v} > {at} AND zrun > 0 AND rp = {tol + 1})", mpl, True)


def choi_sql(source="epochs", v="axis1", at=0, mpl=12, tol=2, mwl=6, wst=1):
    flags = f"""
    SELECT *, row_number() OVER (PARTITION BY subject, zrun ORDER BY epoch_idx) - CASE WHEN zrun > 0 THEN 1 ELSE 0 END AS rp
    FROM (SELECT *, sum(CASE WHEN {v} <= {at} THEN 1 ELSE 0 END) OVER ({W_ALL}) AS zrun,
        count(*) FILTER ({v} > 0) OVER ({W_ALL} ROWS BETWEEN {tol} FOLLOWING AND {mwl} FOLLOWING) AS up,
        count(*) FILTER ({v} > 0) OVER ({W_ALL} ROWS BETWEEN {mwl} PRECEDING AND 2 PRECEDING) AS dn FROM {source})"""
    return period_sql(flags, f"{v} = 0",
                      f"({v} > 0 AND (up > {wst} OR dn > {wst})) OR ({v} > {at} AND zrun > 0 AND rp = 3)", mpl, False)


def hecht(t):
    return D.hecht(t.epochs, F.col("vmu"), epoch_sec=60, **HECHT)


def troiano(t):
    return D.troiano(t.epochs, F.col("axis1"), **TROIANO)


def choi(t):
    return D.choi(t.epochs, F.col("axis1"), **CHOI)


def flags(df):
    return df.select("subject", "epoch_idx", F.col("wear").cast("int").alias("wear"))


@query("t1_hecht_nonwear", f"WITH {EPOCHS_SQL} SELECT subject, epoch_idx, wear FROM ({hecht_sql()})")
def _(t):
    return flags(hecht(t))


@query("t2_troiano_nonwear", f"WITH {EPOCHS_SQL} SELECT subject, epoch_idx, wear FROM ({troiano_sql()})")
def _(t):
    return flags(troiano(t))


@query("t2_troiano_vector_magnitude",
       f"WITH {EPOCHS_SQL} SELECT subject, epoch_idx, wear FROM ({troiano_sql(v='vmu', at=2, tol=2, ss=60)})")
def _(t):
    return flags(D.troiano(t.epochs, F.col("vmu"), 2, 24, 2, 60))


@query("t3_choi_nonwear", f"WITH {EPOCHS_SQL} SELECT subject, epoch_idx, wear FROM ({choi_sql()})")
def _(t):
    return flags(choi(t))


@query("w1_w2_neighbour_counts", f"""WITH {EPOCHS_SQL}
  SELECT subject, epoch_idx,
    count(*) FILTER (vmu > 5) OVER ({W_ALL} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS following,
    count(*) FILTER (vmu > 5) OVER ({W_ALL} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS preceding FROM epochs""")
def _(t):
    return D.neighbour_counts(t.epochs, F.col("vmu") > 5, 20).select("subject", "epoch_idx", "following", "preceding")


@query("w3_gap_around_spike_counts", f"""WITH {EPOCHS_SQL}
  SELECT subject, epoch_idx,
    count(*) FILTER (axis1 > 0) OVER ({W_ALL} ROWS BETWEEN 2 FOLLOWING AND 6 FOLLOWING) AS later,
    count(*) FILTER (axis1 > 0) OVER ({W_ALL} ROWS BETWEEN 6 PRECEDING AND 2 PRECEDING) AS earlier FROM epochs""")
def _(t):
    rows = D.choi_window_counts(t.epochs, F.col("axis1"), 2, 6, "epoch_idx", ("subject",), 65_536)
    return rows.filter(OWN).select("subject", "epoch_idx", F.col("_later").alias("later"), F.col("_earlier").alias("earlier"))


@query("w4_moving_average", f"""WITH {EPOCHS_SQL}
  SELECT subject, epoch_idx, {s6('avg_v', 'moving_avg')} FROM (
    SELECT subject, epoch_idx, avg(axis1) OVER w AS avg_v, count(*) OVER w AS n FROM epochs
    WINDOW w AS ({W_ALL} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) WHERE n = 4""")
def _(t):
    out = moving_average(t.epochs, "axis1", 4, idx="epoch_idx")
    return out.select("subject", "epoch_idx", r6("moving_avg"))


@query("w8_min_max_envelope", f"""WITH {EPOCHS_SQL}
  SELECT subject, epoch_idx, min(axis1) OVER w AS low, max(axis1) OVER w AS high FROM epochs
  WINDOW w AS ({W_ALL} ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)""")
def _(t):
    rows = spread(t.epochs, ("subject",), "epoch_idx", 65_536, 5, 4)
    ends = sliding_extremes(rows, ("subject",), "epoch_idx", 5, 4, {"low": ("min", "axis1"), "high": ("max", "axis1")})
    return ends.filter(OWN).select("subject", "epoch_idx", "low", "high")


def std_sql(c):
    """Population SD from sums, which are exact for the signal (dyadic values)."""
    return f"sqrt(count(*) * sum({c} * {c}) - sum({c}) * sum({c})) / count(*)"


BLOCKS = f"""
blocks AS (
  SELECT subject, idx // {MINUTE} AS block, count(*) AS n,
    {std_sql('y')} AS sy, {std_sql('x')} AS sx, {std_sql('z')} AS sz,
    max(y) - min(y) AS ry, max(x) - min(x) AS rx, max(z) - min(z) AS rz,
    sum(y) AS ty, sum(x) AS tx, sum(z) AS tz
  FROM signal GROUP BY 1, 2)"""


@query("a4_block_std_and_range", f"""WITH {SIGNAL_SQL}, {BLOCKS}
  SELECT subject, block, n, {s6('sy', 'std_y')}, {s6('sx', 'std_x')}, {s6('sz', 'std_z')},
    ry AS range_y, rx AS range_x, rz AS range_z, ty AS sum_y FROM blocks""")
def _(t):
    b = B.block_spread(B.block_stats(t.signal, MINUTE))
    return b.select("subject", "block", "n", *[r6(f"std_{a}") for a in "yxz"], *[f"range_{a}" for a in "yxz"], "sum_y")


@query("a5_axes_below_threshold", f"""WITH {SIGNAL_SQL}, {BLOCKS}
  SELECT subject, block, CAST((sy <= 0.2001) AS INTEGER) + CAST((sx <= 0.2001) AS INTEGER) + CAST((sz <= 0.2001) AS INTEGER) AS quiet_axes,
    sy <= 0.2001 AND sx <= 0.2001 AND sz <= 0.2001 AS all_quiet FROM blocks""")
def _(t):
    b = B.block_spread(B.block_stats(t.signal, MINUTE))
    count = D.axes_below("std", 0.2001, strict=False)
    return b.select("subject", "block", count.alias("quiet_axes"), (count == 3).alias("all_quiet"))


@query("w6_tumbling_windows_short_tail", f"""WITH {SIGNAL_SQL}
  SELECT subject, idx // 7 AS win, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx, sum(y) AS sum_y
  FROM signal GROUP BY 1, 2""")
def _(t):
    return B.block_stats(t.signal, 7).select("subject", F.col("block").alias("win"), "n", "first_idx", "last_idx", "sum_y")


HEES_WIN, HEES_STD, HEES_RANGE = 4, 0.26001, 0.62001
HEES_SQL = f"""
  SELECT subject, block, CASE WHEN max(quiet) OVER (PARTITION BY subject ORDER BY block ROWS BETWEEN {HEES_WIN - 1} PRECEDING AND CURRENT ROW) = 1
    THEN 0 ELSE 1 END AS wear
  FROM (SELECT subject, b AS block, CASE WHEN n = {HEES_WIN * MINUTE} AND (
      CAST(sy < {HEES_STD} AS INTEGER) + CAST(sx < {HEES_STD} AS INTEGER) + CAST(sz < {HEES_STD} AS INTEGER) >= 2 OR
      CAST(ry < {HEES_RANGE} AS INTEGER) + CAST(rx < {HEES_RANGE} AS INTEGER) + CAST(rz < {HEES_RANGE} AS INTEGER) >= 2)
      THEN 1 ELSE 0 END AS quiet
    FROM (SELECT w.subject, w.b, count(*) AS n, stddev_pop(y) AS sy, stddev_pop(x) AS sx, stddev_pop(z) AS sz,
        max(y) - min(y) AS ry, max(x) - min(x) AS rx, max(z) - min(z) AS rz
      FROM (SELECT subject, idx, y, x, z, unnest(range(greatest(idx // {MINUTE} - {HEES_WIN - 1}, 0), idx // {MINUTE} + 1)) AS b FROM signal) w
      GROUP BY 1, 2))"""


@query("t4_hees_nonwear_blocks", f"WITH {SIGNAL_SQL} {HEES_SQL}")
def _(t):
    return hees(t).select("subject", "block", F.col("wear").cast("int").alias("wear"))


def hees(t):
    return hees_of(t.signal)


def hees_of(signal, **size):
    return D.hees(signal, window_mins=HEES_WIN, step_mins=1, std_mg=HEES_STD * 1000, range_mg=HEES_RANGE * 1000,
                  samples_per_min=MINUTE, **size)


@query("w5_sliding_windows_full_only", f"""WITH {SIGNAL_SQL}
  SELECT subject, b AS block, {s6(std_sql('y'), 'std_y')}, max(z) - min(z) AS range_z
  FROM (SELECT subject, y, z, unnest(range(greatest(idx // 10 - 2, 0), idx // 10 + 1)) AS b FROM signal)
  GROUP BY 1, 2 HAVING count(*) = 30""")
def _(t):
    rows = D.hees_windows(B.block_stats(t.signal, 10), 3, 30)
    return rows.filter(F.col(OWN) & F.col("full")).select("subject", "block", r6("std_y"), "range_z")


@query("w5_sliding_windows_step_not_dividing", f"""WITH {SIGNAL_SQL},
  wins AS (SELECT subject, w, count(*) AS n, stddev_pop(y) AS sy, stddev_pop(x) AS sx, stddev_pop(z) AS sz,
      max(y) - min(y) AS ry, max(x) - min(x) AS rx, max(z) - min(z) AS rz
    FROM (SELECT subject, y, x, z, unnest(range(greatest((idx - 15 + 10) // 10, 0), idx // 10 + 1)) AS w FROM signal)
    GROUP BY 1, 2),
  quiet AS (SELECT subject, w FROM wins WHERE n = 15 AND (
      CAST(sy < {HEES_STD} AS INTEGER) + CAST(sx < {HEES_STD} AS INTEGER) + CAST(sz < {HEES_STD} AS INTEGER) >= 2 OR
      CAST(ry < {HEES_RANGE} AS INTEGER) + CAST(rx < {HEES_RANGE} AS INTEGER) + CAST(rz < {HEES_RANGE} AS INTEGER) >= 2)),
  hit AS (SELECT DISTINCT subject, unnest(range(w * 2, w * 2 + 3)) AS block FROM quiet)
  SELECT a.subject, a.block, CASE WHEN h.block IS NULL THEN 1 ELSE 0 END AS wear
  FROM (SELECT DISTINCT subject, idx // 5 AS block FROM signal) a LEFT JOIN hit h ON a.subject = h.subject AND a.block = h.block""")
def _(t):
    out = D.hees(t.signal, window_mins=3, step_mins=2, std_mg=HEES_STD * 1000, range_mg=HEES_RANGE * 1000,
                 samples_per_min=MINUTE)
    return out.select("subject", "block", F.col("wear").cast("int").alias("wear"))


@query("t4_hees_nonwear_samples", f"""WITH {SIGNAL_SQL}, nw AS ({HEES_SQL})
  SELECT s.subject, s.idx, n.wear FROM signal s JOIN nw n ON s.subject = n.subject AND s.idx // {MINUTE} = n.block""")
def _(t):
    out = D.expand_blocks(t.signal, hees(t), MINUTE)
    return out.select("subject", "idx", F.col("wear").cast("int").alias("wear"))


RUNS = """
  SELECT subject, min(epoch_idx) AS start_index, max(epoch_idx) AS stop_index, count(*) AS n
  FROM (SELECT subject, epoch_idx, epoch_idx - row_number() OVER (PARTITION BY subject ORDER BY epoch_idx) AS grp
        FROM {source} WHERE {cond}) GROUP BY subject, grp"""


def runs_sql(source, cond):
    return RUNS.format(source=source, cond=cond)


@query("w7_consecutive_runs", f"""WITH {EPOCHS_SQL}
  SELECT subject, start_index, stop_index FROM ({runs_sql('epochs', 'steps = 0')})""")
def _(t):
    return E.to_episodes(t.epochs, F.col("steps") == 0, "epoch_idx", ts=None, counter=False).select(
        "subject", "start_index", "stop_index")


@query("e1_vector_to_episodes", f"""WITH {EPOCHS_SQL}
  SELECT subject, start_index, stop_index, 1704067200 + start_index * {HOUR} AS start_sec, 1704067200 + stop_index * {HOUR} AS stop_sec,
    row_number() OVER (PARTITION BY subject ORDER BY start_index) - 1 AS counter
  FROM ({runs_sql('epochs', 'truth = 1')})""")
def _(t):
    ep = E.to_episodes(t.epochs, F.col("truth") == 1, "epoch_idx")
    return ep.select("subject", "start_index", "stop_index", F.unix_seconds("start").alias("start_sec"),
                     F.unix_seconds("stop").alias("stop_sec"), "counter")


@query("e2_episodes_to_vector", f"""WITH {EPOCHS_SQL}, r AS ({runs_sql('epochs', 'truth = 1')})
  SELECT e.subject, e.epoch_idx, CAST(CASE WHEN r.subject IS NULL THEN 0 ELSE 1 END AS INTEGER) AS marked
  FROM epochs e LEFT JOIN r ON e.subject = r.subject AND e.epoch_idx >= r.start_index AND e.epoch_idx < r.stop_index""")
def _(t):
    ep = E.to_episodes(t.epochs, F.col("truth") == 1, "epoch_idx", ts=None, counter=False)
    return E.mark_episodes(t.epochs, ep, "epoch_idx").select("subject", "epoch_idx", "marked")


def near_sql(inner, gap):
    return f"""
  SELECT subject, CASE WHEN min(counter) = max(counter) THEN CAST(min(counter) AS VARCHAR)
      ELSE concat(min(counter), '-', max(counter)) END AS counter,
    min(start_index) AS start_index, arg_max(stop_index, start_index) AS stop_index, arg_min(label, start_index) AS label
  FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY start_index) AS ses
        FROM (SELECT *, start_index - lag(stop_index) OVER (PARTITION BY subject ORDER BY start_index) AS gap FROM ({inner})))
  GROUP BY subject, ses"""


LABELLED = f"""
  SELECT subject, start_index, stop_index, CAST((stop_index - start_index) % 2 AS INTEGER) AS label,
    row_number() OVER (PARTITION BY subject ORDER BY start_index) - 1 AS counter
  FROM ({runs_sql('epochs', 'truth = 1')})"""


def labelled(t):
    ep = E.to_episodes(t.epochs, F.col("truth") == 1, "epoch_idx", ts=None)
    return ep.withColumn("label", ((F.col("stop_index") - F.col("start_index")) % 2).cast("int"))


@query("e3_group_near_episodes", f"WITH {EPOCHS_SQL} {near_sql(LABELLED, 33)}")
def _(t):
    out = E.group_near(labelled(t), distance_mins=30, correction=3, samples_per_min=1)
    return out.select("subject", "counter", "start_index", "stop_index", "label")


@query("w9_gap_to_previous_episode", f"""WITH {EPOCHS_SQL}
  SELECT subject, counter, start_index - lag(stop_index) OVER (PARTITION BY subject ORDER BY start_index) AS gap FROM ({LABELLED})""")
def _(t):
    from pyspark.sql import Window as W
    # One row per episode; the hour grid bounds the episodes of a subject.
    along = W.partitionBy("subject").orderBy("start_index")
    return labelled(t).select("subject", "counter", (F.col("start_index") - F.lag("stop_index").over(along)).alias("gap"))


MANUAL = "(SELECT user_id AS subject, min(event_id) % 3 AS first_counter, min(event_id) % 3 + 2 AS last_counter FROM events GROUP BY 1)"


def manual(t):
    return t.raw("events").groupBy(F.col("user_id").alias("subject")).agg(F.min("event_id").alias("_m")).select(
        "subject", (F.col("_m") % 3).alias("first_counter"), (F.col("_m") % 3 + 2).alias("last_counter"))


@query("e4_j10_training_merge", f"""WITH {EPOCHS_SQL}, ep AS ({LABELLED}), mm AS {MANUAL},
  tagged AS (SELECT ep.*, first_counter AS a, last_counter AS b FROM ep LEFT JOIN mm ON ep.subject = mm.subject)
  SELECT subject, concat(a, '-', b) AS counter, arg_min(start_index, counter) AS start_index, arg_max(stop_index, counter) AS stop_index,
    arg_min(label, counter) AS label, 'listed' AS source FROM tagged WHERE counter = a OR counter = b GROUP BY subject, a, b
  UNION ALL SELECT subject, CAST(counter AS VARCHAR), start_index, stop_index, label, 'kept' FROM tagged
    WHERE label = 0 AND NOT coalesce(counter BETWEEN a AND b, false)
  UNION ALL SELECT subject, counter, start_index, stop_index, label, 'grouped' FROM ({near_sql('SELECT * FROM ep WHERE label = 1', 33)})""")
def _(t):
    return E.merge_training_episodes(labelled(t), manual(t), 30, 3, samples_per_min=1)


@query("j9_label_correction", f"""WITH {EPOCHS_SQL}, ep AS ({LABELLED}),
  fix AS (SELECT DISTINCT user_id AS subject, event_id % 5 AS counter FROM events WHERE event_type = 'error')
  SELECT ep.subject, ep.counter, CAST(CASE WHEN fix.subject IS NULL THEN label ELSE 1 - label END AS INTEGER) AS label
  FROM ep LEFT JOIN fix ON ep.subject = fix.subject AND ep.counter = fix.counter""")
def _(t):
    fixes = t.raw("events").filter("event_type = 'error'").select(
        F.col("user_id").alias("subject"), (F.col("event_id") % 5).alias("counter"))
    return E.correct_labels(labelled(t), fixes).select("subject", "counter", "label")


@query("e8_episode_length_overview", f"""WITH {EPOCHS_SQL}, l AS (SELECT n // 2 AS length FROM ({runs_sql('epochs', 'truth = 1')})),
  tot AS (SELECT sum(c // 2) AS recorded FROM (SELECT count(*) AS c FROM epochs GROUP BY subject)),
  k AS (SELECT 'all' AS grp, length FROM l UNION ALL SELECT CASE WHEN length < 12 THEN 'shorter' ELSE 'longer' END, length FROM l)
  SELECT grp, count(*) AS episodes, {s6('avg(length)', 'mean_length')}, {s6('stddev_pop(length)', 'sd_length')},
    CAST(sum(length) AS BIGINT) AS total_length, CAST(max(recorded) AS BIGINT) AS recorded,
    {s6('sum(length) / max(recorded) * 100', 'share_of_time')}, {s6('count(*) / (SELECT count(*) FROM l) * 100', 'share_of_episodes')}
  FROM k, tot GROUP BY grp""")
def _(t):
    ep = E.to_episodes(t.epochs, F.col("truth") == 1, "epoch_idx", ts=None, counter=False)
    units = t.epochs.groupBy("subject").agg(F.expr("count(1) div 2").alias("units"))
    out = E.length_overview(E.durations(ep, 2), units, split=12)
    return out.select("grp", "episodes", r6("mean_length"), r6("sd_length"), "total_length", "recorded",
                      r6("share_of_time"), r6("share_of_episodes"))


@query("e9_hour_of_day_distribution", f"""WITH {EPOCHS_SQL},
  m AS (SELECT subject, epoch_idx % 24 AS hour, sum(truth) AS m FROM epochs GROUP BY 1, 2),
  c AS (SELECT hour, count(*) FILTER (m > 0) AS any_nw, count(*) FILTER (m > 0 AND m <= 12) AS short_nw, count(*) FILTER (m > 12) AS long_nw FROM m GROUP BY 1),
  f AS (SELECT CAST(h.i AS INTEGER) AS hour, coalesce(any_nw, 0) AS any_nw, coalesce(short_nw, 0) AS short_nw, coalesce(long_nw, 0) AS long_nw
    FROM range(24) h(i) LEFT JOIN c ON h.i = c.hour)
  SELECT *, {s6('any_nw / sum(any_nw) OVER ()', 'any_share')}, {s6('short_nw / sum(short_nw) OVER ()', 'short_share')},
    {s6('long_nw / sum(long_nw) OVER ()', 'long_share')} FROM f""")
def _(t):
    out = E.hour_distribution(t.epochs, split=12)
    return out.select("hour", "any_nw", "short_nw", "long_nw", r6("any_share"), r6("short_share"), r6("long_share"))


THR = 0.1501
CANDIDATES = f"""
cand AS (SELECT subject, idx // {MINUTE} AS block FROM signal GROUP BY 1, 2
         HAVING stddev_pop(y) <= {THR} AND stddev_pop(x) <= {THR} AND stddev_pop(z) <= {THR}),
isl AS (SELECT subject, min(block) AS b0, max(block) AS b1
        FROM (SELECT *, block - row_number() OVER (PARTITION BY subject ORDER BY block) AS g FROM cand) GROUP BY subject, g)"""


@query("t5_candidate_segments_ungrown", f"""WITH {SIGNAL_SQL}, {CANDIDATES}
  SELECT subject, b0 * {MINUTE} AS start_index, b1 * {MINUTE} + {MINUTE - 1} AS stop_index FROM isl WHERE b1 > b0""")
def _(t):
    # What growth starts from: the islands alone.
    islands = S.stationary_islands(S.minute_table(t.signal, MINUTE), THR, MINUTE)
    return islands.filter("b1 > b0").select("subject", (F.col("b0") * MINUTE).alias("start_index"),
                                            (F.col("b1") * MINUTE + MINUTE - 1).alias("stop_index"))


# Growth step by step in a recursive query: back first, then forward, always over raw samples.
def grown_sql(thr, by=""):
    """SQL of grown segments ``un`` from the islands ``isl``; ``by`` names further keys, each with a comma."""
    return f"""
pre AS (SELECT subject, idx, sum(1) OVER w AS n, sum(y) OVER w AS y1, sum(x) OVER w AS x1, sum(z) OVER w AS z1,
    sum(y * y) OVER w AS y2, sum(x * x) OVER w AS x2, sum(z * z) OVER w AS z2 FROM signal WINDOW w AS (PARTITION BY subject ORDER BY idx)
  UNION ALL SELECT DISTINCT subject, -1, 0, 0, 0, 0, 0, 0, 0 FROM signal),
tail AS (SELECT subject, max(idx) + 1 AS total FROM signal GROUP BY 1),
grow AS (
  SELECT {by}subject, b0, b0 * {MINUTE} AS s, b1 * {MINUTE} + {MINUTE - 1} AS e, 0 AS phase, 0 AS k FROM isl
  UNION ALL
  SELECT {by}g.subject, g.b0,
    CASE WHEN g.phase = 0 AND ok THEN g.s - {MINUTE} ELSE g.s END, CASE WHEN g.phase = 1 AND ok THEN g.e + {MINUTE} ELSE g.e END,
    CASE WHEN ok THEN g.phase ELSE g.phase + 1 END, g.k + 1
  FROM (
    SELECT g.*, coalesce(
        (hi.n - lo.n) * (hi.y2 - lo.y2) - (hi.y1 - lo.y1) * (hi.y1 - lo.y1) <= {thr} * {thr} * (hi.n - lo.n) * (hi.n - lo.n)
        AND (hi.n - lo.n) * (hi.x2 - lo.x2) - (hi.x1 - lo.x1) * (hi.x1 - lo.x1) <= {thr} * {thr} * (hi.n - lo.n) * (hi.n - lo.n)
        AND (hi.n - lo.n) * (hi.z2 - lo.z2) - (hi.z1 - lo.z1) * (hi.z1 - lo.z1) <= {thr} * {thr} * (hi.n - lo.n) * (hi.n - lo.n), false) AS ok
    FROM grow g
    LEFT JOIN pre lo ON lo.subject = g.subject AND lo.idx = CASE WHEN g.phase = 0 THEN g.s - {MINUTE} ELSE g.s END - 1
    LEFT JOIN pre hi ON hi.subject = g.subject AND hi.idx = CASE WHEN g.phase = 0 THEN g.e ELSE g.e + {MINUTE} END - 1
    WHERE g.phase < 2) g),
fin AS (SELECT {by}subject, b0, arg_max(s, k) AS s, arg_max(e, k) AS e FROM grow GROUP BY {by}subject, b0),
kept AS (SELECT * FROM fin WHERE e - s >= {MINUTE}),
un AS (SELECT {by}subject, min(s) AS start_index, max(e) AS stop_index FROM (
    SELECT *, sum(CASE WHEN s > m OR m IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY {by}subject ORDER BY s, e) AS u
    FROM (SELECT *, max(e) OVER (PARTITION BY {by}subject ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM kept))
  GROUP BY {by}subject, u)"""


GROWN = grown_sql(THR)


@query("t5_t6_candidate_segments_grown", f"WITH RECURSIVE {SIGNAL_SQL}, {CANDIDATES}, {GROWN} SELECT subject, start_index, stop_index FROM un")
def _(t):
    return S.candidate_segments(t.signal, THR, samples_per_min=MINUTE).select("subject", "start_index", "stop_index")


EPISODES = f"""{GROWN},
eps AS MATERIALIZED (SELECT subject, start_index AS a, stop_index - 1 AS b, row_number() OVER (PARTITION BY subject ORDER BY start_index) - 1 AS counter
    FROM un WHERE stop_index > start_index)"""


@query("t8_baseline", f"""WITH RECURSIVE {SIGNAL_SQL}, {CANDIDATES}, {EPISODES}
  SELECT subject, a AS start_index, b AS stop_index FROM eps WHERE (b - a) // {MINUTE} >= 3""")
def _(t):
    return S.baseline(t.signal, THR, 3, samples_per_min=MINUTE).select("subject", "start_index", "stop_index")


@query("e1_candidate_episodes_numbered", f"""WITH RECURSIVE {SIGNAL_SQL}, {CANDIDATES}, {EPISODES}
  SELECT subject, a AS start_index, b AS stop_index, counter FROM eps""")
def _(t):
    return candidate_episodes(t).select("subject", "start_index", "stop_index", "counter")


def candidate_episodes(t):
    return S.as_episodes(S.candidate_segments(t.stored_signal, THR, samples_per_min=MINUTE))


HZ = 3
EDGE_THR = 0.1201
# Second by second from each edge; k counts the seconds that pass one after the other.
REFINED = f"""
walk AS (
  SELECT subject, counter, 1 AS way, b AS pos, true AS live, 0 AS k FROM eps
  UNION ALL SELECT subject, counter, -1, a, true, 0 FROM eps
  UNION ALL
  SELECT subject, counter, way, CASE WHEN ok THEN pos + way * {HZ} ELSE pos END, ok, k + 1 FROM (
    SELECT g.*, coalesce(
        {HZ} * (hi.y2 - lo.y2) - (hi.y1 - lo.y1) * (hi.y1 - lo.y1) <= {EDGE_THR * EDGE_THR * HZ * HZ}
        AND {HZ} * (hi.x2 - lo.x2) - (hi.x1 - lo.x1) * (hi.x1 - lo.x1) <= {EDGE_THR * EDGE_THR * HZ * HZ}
        AND {HZ} * (hi.z2 - lo.z2) - (hi.z1 - lo.z1) * (hi.z1 - lo.z1) <= {EDGE_THR * EDGE_THR * HZ * HZ}, false) AS ok
    FROM walk g
    LEFT JOIN pre lo ON lo.subject = g.subject AND lo.idx = CASE WHEN g.way = 1 THEN g.pos ELSE g.pos - {HZ} END - 1
    LEFT JOIN pre hi ON hi.subject = g.subject AND hi.idx = CASE WHEN g.way = 1 THEN g.pos + {HZ} ELSE g.pos END - 1
    WHERE g.live AND g.k < {HZ * 60 * 5}) g),
edges AS (SELECT subject, counter, max(pos) FILTER (way = 1) AS b, min(pos) FILTER (way = -1) AS a FROM walk GROUP BY 1, 2)"""


def refined(t):
    return S.refine_edges(t.stored_signal, candidate_episodes(t), EDGE_THR, HZ)


@query("t7_refined_edges", f"""WITH RECURSIVE {SIGNAL_SQL}, {CANDIDATES}, {EPISODES}, {REFINED}
  SELECT subject, counter, a AS start_index, b AS stop_index FROM edges""")
def _(t):
    return refined(t).select("subject", "counter", "start_index", "stop_index")


@query("e5_gold_standard_vector", f"""WITH RECURSIVE {SIGNAL_SQL}, {CANDIDATES}, {EPISODES}, {REFINED}
  SELECT s.subject, s.idx, CAST(coalesce(max(CASE WHEN e.subject IS NOT NULL THEN 1 END), 0) AS INTEGER) AS nw
  FROM signal s LEFT JOIN edges e ON s.subject = e.subject AND s.idx >= e.a AND s.idx < e.b GROUP BY 1, 2""")
def _(t):
    return E.mark_episodes(t.stored_signal, refined(t), block_rows=512, name="nw").select("subject", "idx", "nw")


@query("t9_a7_v1_troiano_scores_per_subject", f"""WITH {EPOCHS_SQL}, d AS (SELECT subject, 1 - wear AS nw, truth FROM ({troiano_sql()})),
  c AS (SELECT subject, count(*) FILTER (truth = 0 AND nw = 0) AS tn, count(*) FILTER (truth = 0 AND nw = 1) AS fp,
    count(*) FILTER (truth = 1 AND nw = 0) AS fn, count(*) FILTER (truth = 1 AND nw = 1) AS tp FROM d GROUP BY 1)
  SELECT subject, tn, fp, fn, tp, {s6('(tp + tn) / (tn + fp + fn + tp)', 'accuracy')},
    {s6('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END', 'precision')}, {s6('CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END', 'specificity')},
    {s6('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END', 'recall')}, {s6('CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END', 'f1')},
    {s6('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END', 'ppv')}, {s6('CASE WHEN tn + fn > 0 THEN tn / (tn + fn) END', 'npv')} FROM c""")
def _(t):
    return troiano_scores(t)


def troiano_scores(t):
    scored = troiano(t).groupBy("subject").agg(*confusion("truth", 1 - F.col("wear")))
    return with_metrics(scored).select(
        "subject", "tn", "fp", "fn", "tp", *[r6(m) for m in ("accuracy", "precision", "specificity", "recall", "f1", "ppv", "npv")])
