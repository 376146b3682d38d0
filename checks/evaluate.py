"""Scoring, parameter searches, cross-validation and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.detect import (
    grown_sql,
    CHOI, HECHT, HEES_SQL, HOUR, TROIANO, choi, choi_sql, hecht, hecht_sql, hees_of, runs_sql, troiano, troiano_sql,
)
from checks.registry import query, r6, s6
from checks.tables import EPOCHS_SQL, MINUTE, SIGNAL_SQL
from stillwave.functions.fixed_values import CHOI_SPACE, HECHT_SPACE, TROIANO_SPACE
from stillwave.functions.expressions import parameter_key
from stillwave.functions.metrics import METRICS, sum_confusion, with_metrics
from stillwave.operators import align as A, blocks as B, chunked, detectors as D, episodes as E, overlay
from stillwave.plans.detection import detect_counts
from stillwave.plans import cv, grid as G, models, reports

METRIC_SQL = ", ".join([
    "(tp + tn) / (tn + fp + fn + tp) AS accuracy", "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision",
    "CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END AS specificity", "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall",
    "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1", "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS ppv",
    "CASE WHEN tn + fn > 0 THEN tn / (tn + fn) END AS npv"])
M6 = ", ".join(s6(m, m) for m in METRICS)


def cells(y, p):
    return ", ".join(f"count(*) FILTER ({y} = {a} AND {p} = {b}) AS {n}" for a, b, n in
                     [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")])


def metrics6(df, *keys):
    return df.select(*keys, *[r6(m) for m in METRICS])


# ---- label matrix and totals -----------------------------------------------------------

MATRIX = f"""
h AS MATERIALIZED ({hecht_sql()}), tr AS MATERIALIZED ({troiano_sql()}), c AS MATERIALIZED ({choi_sql()}),
lm AS MATERIALIZED (SELECT h.subject, h.epoch_idx, h.truth, 1 - h.wear AS hecht, 1 - tr.wear AS troiano, 1 - c.wear AS choi
  FROM h JOIN tr ON h.subject = tr.subject AND h.epoch_idx = tr.epoch_idx JOIN c ON h.subject = c.subject AND h.epoch_idx = c.epoch_idx)"""


def matrix(t):
    """One pass per detector over the same rows; no join back."""
    return matrix_with_vmu(t).select("subject", "epoch_idx", "truth", *METHODS)


def matrix_with_vmu(t, epochs=None):
    # The calendar bounds a subject's rows, so they stay in the task where they are made.
    epochs = t.placed("epochs")[0] if epochs is None else epochs
    return detect_counts(epochs, {
        "hecht": lambda df: D.hecht(df, F.col("vmu"), epoch_sec=60, **HECHT, size=None),
        "troiano": lambda df: D.troiano(df, F.col("axis1"), **TROIANO, size=None),
        "choi": lambda df: D.choi(df, F.col("axis1"), **CHOI, size=None),
    }).select("subject", "epoch_idx", "truth", "vmu", *METHODS)


METHODS = ["hecht", "troiano", "choi"]


@query("v2_label_matrix_by_join", f"WITH {EPOCHS_SQL}, {MATRIX} SELECT * FROM lm")
def _(t):
    nw = lambda df: df.select("subject", "epoch_idx", (1 - F.col("wear")).cast("int").alias("nw"))
    truth = t.epochs.select("subject", "epoch_idx", F.col("truth").alias("nw"))
    return A.label_matrix(truth, {"hecht": nw(hecht(t)), "troiano": nw(troiano(t)), "choi": nw(choi(t))},
                          on=("subject", "epoch_idx"))


@query("v2_label_matrix", f"WITH {EPOCHS_SQL}, {MATRIX} SELECT * FROM lm")
def _(t):
    return matrix(t)


TOTALS = f"""{MATRIX}, lng AS (SELECT epoch_idx, truth, 'hecht' AS method, hecht AS p FROM lm UNION ALL SELECT epoch_idx, truth, 'troiano', troiano FROM lm
    UNION ALL SELECT epoch_idx, truth, 'choi', choi FROM lm),
  vr AS (SELECT 'all' AS variant, * FROM lng UNION ALL SELECT 'daytime', * FROM lng WHERE epoch_idx % 24 BETWEEN 7 AND 23),
  tot AS (SELECT variant, method, {cells('truth', 'p')} FROM vr GROUP BY 1, 2),
  res AS (SELECT *, {METRIC_SQL} FROM tot)"""


def totals(t):
    m = matrix(t).withColumn("ts", F.timestamp_seconds(F.col("epoch_idx") * HOUR))
    return reports.method_totals(m, METHODS)


@query("v3_v4_method_totals", f"WITH {EPOCHS_SQL}, {TOTALS} SELECT variant, method, tn, fp, fn, tp, {M6} FROM res")
def _(t):
    return metrics6(totals(t), "variant", "method", "tn", "fp", "fn", "tp")


# ---- four methods on one clock ---------------------------------------------------------
# An epoch is three ticks and five samples of the signal are one, so that both directions of scaling are used.

TICKS, EVERY = 3, 5
FOUR = [*METHODS, "hees"]
SECONDS_SQL = f"""{MATRIX},
hs AS MATERIALIZED ({HEES_SQL}),
sig AS MATERIALIZED (SELECT subject, idx // {EVERY} AS sec, CAST(CASE WHEN y = 0 THEN 1 ELSE 0 END AS INTEGER) AS truth FROM signal WHERE idx % {EVERY} = 0),
sc AS MATERIALIZED (SELECT g.subject, g.sec, g.truth, lm.hecht, lm.troiano, lm.choi, 1 - hs.wear AS hees
  FROM sig g JOIN lm ON lm.subject = g.subject AND lm.epoch_idx = g.sec // {TICKS}
  JOIN hs ON hs.subject = g.subject AND hs.block = g.sec * {EVERY} // {MINUTE})"""


def four_methods(t):
    """Counts and raw signal of the same subjects, every label as change points."""
    epochs, signal = t.placed("epochs", "signal")
    counts = matrix_with_vmu(t, epochs).select("subject", "epoch_idx", *METHODS)
    raw = signal.select("subject", "idx", F.when(F.col("y") == 0, 1).otherwise(0).alias("truth"))
    return overlay.overlay({
        "raw": overlay.scaled(overlay.change_points(raw, ["truth"], size=None), every=EVERY),
        "counts": overlay.scaled(overlay.change_points(counts, METHODS, "epoch_idx", size=None), repeat=TICKS),
        "blocks": overlay.scaled(overlay.change_points(placed_blocks(signal), ["hees"], "block", size=None), repeat=MINUTE, every=EVERY)})


def placed_blocks(signal):
    return hees_of(signal, size=None).select("subject", "block", (1 - F.col("wear")).cast("int").alias("hees"))


@query("v2_label_matrix_four_methods", f"WITH {EPOCHS_SQL}, {SIGNAL_SQL}, {SECONDS_SQL} SELECT * FROM sc")
def _(t):
    return overlay.per_tick(four_methods(t)).select("subject", "sec", "truth", *FOUR)


@query("v2_label_vector_counts", f"WITH {EPOCHS_SQL}, {SIGNAL_SQL}, {SECONDS_SQL} SELECT subject, truth, hecht, troiano, choi, hees, count(*) AS n FROM sc GROUP BY ALL")
def _(t):
    return overlay.vector_counts(four_methods(t), ["truth", *FOUR])


FOUR_TOTALS = f"""{SECONDS_SQL}, lng AS ({' UNION ALL '.join(f"SELECT subject, sec, truth, '{m}' AS method, {m} AS p FROM sc" for m in FOUR)}),
  vr AS (SELECT 'all' AS variant, * FROM lng UNION ALL SELECT 'daytime', * FROM lng WHERE (sec + subject * 977) % 86400 BETWEEN 25200 AND 82800),
  tot AS (SELECT variant, method, {cells('truth', 'p')} FROM vr GROUP BY 1, 2),
  res AS (SELECT *, {METRIC_SQL} FROM tot)"""


def four_totals(t):
    """Clocks start at a time of day that the subject tells."""
    return reports.overlay_totals(four_methods(t), FOUR, F.pmod(F.col("subject") * 977, F.lit(86_400)))


@query("v3_v4_four_method_totals", f"WITH {EPOCHS_SQL}, {SIGNAL_SQL}, {FOUR_TOTALS} SELECT variant, method, tn, fp, fn, tp, {M6} FROM res")
def _(t):
    return metrics6(four_totals(t), "variant", "method", "tn", "fp", "fn", "tp")


@query("q10_timeline_with_raw_and_hees", f"""WITH {EPOCHS_SQL}, {SIGNAL_SQL}, {MATRIX}, hs AS MATERIALIZED ({HEES_SQL}),
  lv AS (SELECT subject, epoch_idx * {MINUTE} AS idx, hecht, troiano, choi FROM lm),
  cv AS (SELECT subject, epoch_idx * {MINUTE} AS idx, vmu FROM epochs),
  hv AS (SELECT subject, block * {MINUTE} AS idx, 1 - wear AS hees FROM hs),
  k AS (SELECT subject, idx FROM signal UNION SELECT subject, idx FROM lv)
  SELECT k.subject, k.idx, s.y, s.x, s.z, CAST(CASE WHEN s.y = 0 THEN 1 WHEN s.y IS NOT NULL THEN 0 END AS INTEGER) AS truth,
    CAST(lv.hecht AS INTEGER) AS hecht, CAST(lv.troiano AS INTEGER) AS troiano, CAST(lv.choi AS INTEGER) AS choi, CAST(hv.hees AS INTEGER) AS hees, {s6('cv.vmu', 'vmu')}
  FROM k LEFT JOIN signal s ON s.subject = k.subject AND s.idx = k.idx LEFT JOIN lv ON lv.subject = k.subject AND lv.idx = k.idx
  LEFT JOIN cv ON cv.subject = k.subject AND cv.idx = k.idx LEFT JOIN hv ON hv.subject = k.subject AND hv.idx = k.idx""")
def _(t):
    """Each table of any rate comes in once; what it has at a time is one struct."""
    epochs, signal = t.placed("epochs", "signal")
    blocks = placed_blocks(signal)
    raw = signal.withColumn("truth", F.when(F.col("y") == 0, 1).otherwise(0))
    line = A.outer_timeline({
        "raw": raw.select("subject", "idx", F.struct("y", "x", "z", "truth").alias("value")),
        "counts": matrix_with_vmu(t, epochs).select("subject", (F.col("epoch_idx") * MINUTE).alias("idx"), F.struct("vmu", *METHODS).alias("value")),
        "blocks": blocks.select("subject", (F.col("block") * MINUTE).alias("idx"), F.struct("hees").alias("value"))}, ("subject", "idx"))
    return line.select("subject", "idx", "raw.y", "raw.x", "raw.z", "raw.truth", *[f"counts.{m}" for m in METHODS], "blocks.hees",
                       r6(F.col("counts.vmu"), "vmu"))


@query("v5_confidence_half_widths", f"WITH {EPOCHS_SQL}, {TOTALS} SELECT variant, method, {', '.join(s6(f'1.96 * sqrt({m} * (1 - {m}) / 583)', f'{m}_ci') for m in METRICS)} FROM res")
def _(t):
    return reports.intervals(totals(t), 583).select("variant", "method", *[r6(f"{m}_ci") for m in METRICS])


@query("o6_transposed_results", f"""WITH {EPOCHS_SQL}, {TOTALS},
  u AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, method, {m} AS value FROM res WHERE variant = 'all'" for m in METRICS)})
  SELECT metric, {', '.join(s6(f"max(value) FILTER (method = '{x}')", x) for x in METHODS)} FROM u GROUP BY 1""")
def _(t):
    wide = reports.transpose(totals(t).filter("variant = 'all'"), "method", METRICS, METHODS)
    return wide.select("metric", *[r6(m) for m in METHODS])


@query("v1_interval_level_scoring", f"""WITH {EPOCHS_SQL}, tr AS ({troiano_sql()}) SELECT subject, {cells('truth', '(1 - wear)')} FROM tr GROUP BY 1""")
def _(t):
    nw = troiano(t)
    span = lambda cond: E.to_episodes(nw, cond, "epoch_idx", ts=None, counter=False).select(
        "subject", F.col("start_index").alias("start"), (F.col("stop_index") + 1).alias("stop"))
    n = t.epochs.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    return E.overlap_confusion(span(F.col("wear") == 0), span(F.col("truth") == 1), n)


# ---- parameter searches ----------------------------------------------------------------

HECHT_GRID = {"t": [5, 25, 50], "i": [10, 20, 30], "m": [1, 2, 3]}
TROIANO_GRID = {"at": [0, 25], "mpl": [12, 24, 48], "st": [1, 2], "ss": [20, 60], "vm": [True, False]}
CHOI_GRID = {"at": [0, 25], "mpl": [12, 24], "st": [1, 2], "mwl": [6, 12], "wst": [0, 1], "vm": [True, False]}
# Thresholds off the values that the daily signal takes exactly (multiples of 1/64, spreads of 0.15).
HEES_GRID = {"mw": [2, 4, 6], "wo": [1], "st": [151, 262], "sa": [1, 2, 3], "vt": [401, 621], "va": [1, 2, 3]}


def values(name, items):
    return f"(VALUES {', '.join(f'({str(i).lower() if isinstance(i, bool) else i})' for i in items)}) {name.strip(chr(34))}_({name})"


def hecht_grid_sql(space=HECHT_GRID):
    parts = []
    for w in space["i"]:
        parts.append(f"""SELECT subject, t, {w} AS i, m, truth, CASE WHEN vmu > t THEN greatest(f, p) ELSE least(f, p) END < m AS nw FROM (
      SELECT subject, t, vmu, truth,
        count(*) FILTER (vmu > t) OVER (PARTITION BY subject, t ORDER BY epoch_idx ROWS BETWEEN 1 FOLLOWING AND {w} FOLLOWING) AS f,
        count(*) FILTER (vmu > t) OVER (PARTITION BY subject, t ORDER BY epoch_idx ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS p
      FROM epochs, {values('t', space['t'])}), {values('m', space['m'])}""")
    body = " UNION ALL ".join(parts)
    return f"SELECT subject, t, i, m, {cells('truth', 'CAST(nw AS INTEGER)')} FROM ({body}) GROUP BY ALL"


def troiano_grid_sql():
    w = 'PARTITION BY subject, "at", st, ss, vm ORDER BY epoch_idx'
    g = 'PARTITION BY subject, "at", st, ss, vm'
    return f"""SELECT subject, "at", mpl, st, ss, vm, {cells('truth', 'CAST(nw AS INTEGER)')} FROM (
      SELECT *, coalesce(e - s >= mpl AND epoch_idx >= s AND epoch_idx < e, false) AS nw FROM (
        SELECT *, min(CASE WHEN v <= least("at", ss) THEN epoch_idx END) OVER ({g}, grp) AS s, max(CASE WHEN trm THEN epoch_idx END) OVER ({g}, grp) AS e FROM (
          SELECT *, coalesce(sum(CAST(trm AS INTEGER)) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM (
            SELECT *, v > ss OR (v > "at" AND zrun > 0 AND rp = st + 1) OR epoch_idx = 719 AS trm FROM (
              SELECT *, row_number() OVER ({g}, zrun ORDER BY epoch_idx) - CAST(zrun > 0 AS INTEGER) AS rp FROM (
                SELECT *, sum(CASE WHEN v <= least("at", ss) THEN 1 ELSE 0 END) OVER ({w}) AS zrun FROM (
                  SELECT *, CASE WHEN vm THEN vmu ELSE axis1 END AS v FROM epochs, {values('"at"', TROIANO_GRID['at'])}, {values('st', TROIANO_GRID['st'])},
                    {values('ss', TROIANO_GRID['ss'])}, {values('vm', TROIANO_GRID['vm'])})))))), {values('mpl', TROIANO_GRID['mpl'])}) GROUP BY ALL"""


def choi_grid_sql():
    parts = []
    for st in CHOI_GRID["st"]:
        for mwl in CHOI_GRID["mwl"]:
            parts.append(f"""SELECT subject, epoch_idx, truth, vm, v, {st} AS st, {mwl} AS mwl,
        count(*) FILTER (v > 0) OVER (PARTITION BY subject, vm ORDER BY epoch_idx ROWS BETWEEN {st} FOLLOWING AND {mwl} FOLLOWING) AS up,
        count(*) FILTER (v > 0) OVER (PARTITION BY subject, vm ORDER BY epoch_idx ROWS BETWEEN {mwl} PRECEDING AND 2 PRECEDING) AS dn
      FROM (SELECT *, CASE WHEN vm THEN vmu ELSE axis1 END AS v FROM epochs, {values('vm', CHOI_GRID['vm'])})""")
    g = 'PARTITION BY subject, "at", st, mwl, wst, vm'
    return f"""SELECT subject, "at", mpl, st, mwl, wst, vm, {cells('truth', 'CAST(nw AS INTEGER)')} FROM (
      SELECT *, coalesce(e - s >= mpl AND epoch_idx >= s AND epoch_idx < e, false) AS nw FROM (
        SELECT *, min(CASE WHEN v = 0 THEN epoch_idx END) OVER ({g}, grp) AS s, max(CASE WHEN trm THEN epoch_idx END) OVER ({g}, grp) AS e FROM (
          SELECT *, coalesce(sum(CAST(trm AS INTEGER)) OVER ({g} ORDER BY epoch_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM (
            SELECT *, (v > 0 AND (up > wst OR dn > wst)) OR (v > "at" AND zrun > 0 AND rp = 3) AS trm FROM (
              SELECT *, row_number() OVER ({g}, zrun ORDER BY epoch_idx) - CAST(zrun > 0 AS INTEGER) AS rp FROM (
                SELECT *, sum(CASE WHEN v <= "at" THEN 1 ELSE 0 END) OVER ({g} ORDER BY epoch_idx) AS zrun
                FROM ({' UNION ALL '.join(parts)}), {values('"at"', CHOI_GRID['at'])}, {values('wst', CHOI_GRID['wst'])}))))), {values('mpl', CHOI_GRID['mpl'])}) GROUP BY ALL"""


def hees_grid_sql():
    parts = []
    for mw in HEES_GRID["mw"]:
        parts.append(f"""SELECT {mw} AS mw2, subject, b, stddev_pop(y) AS sy, stddev_pop(x) AS sx, stddev_pop(z) AS sz,
        max(y) - min(y) AS ry, max(x) - min(x) AS rx, max(z) - min(z) AS rz
      FROM (SELECT subject, y, x, z, unnest(range(greatest(idx // {MINUTE} - {mw - 1}, 0), idx // {MINUTE} + 1)) AS b FROM signal)
      GROUP BY subject, b HAVING count(*) = {mw * MINUTE}""")
    return f"""SELECT subject, mw, 1 AS wo, st, sa, vt, va, {', '.join(f'CAST(sum(CASE WHEN truth = {a} AND nw = {b} THEN n ELSE 0 END) AS BIGINT) AS {c}' for a, b, c in [(0, 0, 'tn'), (0, 1, 'fp'), (1, 0, 'fn'), (1, 1, 'tp')])}
    FROM (SELECT t.subject, mw, st, sa, vt, va, t.block, t.truth, {MINUTE} AS n, max(CAST(w.b IS NOT NULL AS INTEGER)) AS nw
      FROM (SELECT subject, idx // {MINUTE} AS block, CASE WHEN max(y) = 0 THEN 1 ELSE 0 END AS truth FROM signal GROUP BY 1, 2) t
      CROSS JOIN {values('mw', HEES_GRID['mw'])} CROSS JOIN {values('st', HEES_GRID['st'])} CROSS JOIN {values('sa', HEES_GRID['sa'])}
      CROSS JOIN {values('vt', HEES_GRID['vt'])} CROSS JOIN {values('va', HEES_GRID['va'])}
      LEFT JOIN (SELECT w.*, st2, sa2, vt2, va2, unnest(range(b, b + mw2)) AS block FROM ({' UNION ALL '.join(parts)}) w,
          (VALUES {', '.join(f'({s})' for s in HEES_GRID['st'])}) a(st2), (VALUES (1), (2), (3)) b(sa2), (VALUES {', '.join(f'({s})' for s in HEES_GRID['vt'])}) c(vt2), (VALUES (1), (2), (3)) d(va2)
        WHERE CAST(sy < st2 / 1000 AS INTEGER) + CAST(sx < st2 / 1000 AS INTEGER) + CAST(sz < st2 / 1000 AS INTEGER) >= sa2
           OR CAST(ry < vt2 / 1000 AS INTEGER) + CAST(rx < vt2 / 1000 AS INTEGER) + CAST(rz < vt2 / 1000 AS INTEGER) >= va2) w
        ON w.subject = t.subject AND w.block = t.block AND w.mw2 = mw AND w.st2 = st AND w.sa2 = sa AND w.vt2 = vt AND w.va2 = va
      GROUP BY ALL) GROUP BY ALL"""


def conf_hecht(t):
    return G.hecht_grid(t.epochs, HECHT_GRID)


def conf_troiano(t):
    return G.troiano_grid(t.epochs, TROIANO_GRID)


def conf_choi(t):
    return G.choi_grid(t.epochs, CHOI_GRID)


@query("g2_g3_hecht_grid", f"WITH {EPOCHS_SQL} {hecht_grid_sql()}")
def _(t):
    return conf_hecht(t)


@query("g2_g3_troiano_grid", f"WITH {EPOCHS_SQL} {troiano_grid_sql()}")
def _(t):
    return conf_troiano(t)


@query("g2_g3_choi_grid", f"WITH {EPOCHS_SQL} {choi_grid_sql()}")
def _(t):
    return conf_choi(t)


@query("g2_g3_hees_grid", f"WITH {SIGNAL_SQL} {hees_grid_sql()}")
def _(t):
    signal, = t.placed("signal")
    blocks = B.block_stats(signal, MINUTE).withColumn("truth", F.when(F.col("max_y") == 0, F.col("n")).otherwise(0))
    return G.hees_grid(blocks, None, HEES_GRID, MINUTE, size=None)


HP, TP_ = ("t", "i", "m"), ("at", "mpl", "st", "ss", "vm")


# The whole published spaces, summed over subjects. The SQL of Hecht reads a row for each threshold and window; the other
# two would multiply the rows by hundreds there, so tests hold combinations of theirs against the detectors run alone.
@query("g2_hecht_whole_space", f"""WITH {EPOCHS_SQL}, gs AS ({hecht_grid_sql(HECHT_SPACE)})
  SELECT t, i, m, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tp) AS BIGINT) AS tp FROM gs GROUP BY 1, 2, 3""")
def _(t):
    return sum_confusion(G.hecht_grid(t.epochs, HECHT_SPACE, by=()), *HECHT_SPACE)


@query("g2_troiano_whole_space")
def _(t):
    return sum_confusion(G.troiano_grid(t.epochs, TROIANO_SPACE, by=()), *TROIANO_SPACE)


@query("g2_choi_whole_space")
def _(t):
    return sum_confusion(G.choi_grid(t.epochs, CHOI_SPACE, by=()), *CHOI_SPACE)


GRID_TOTALS = f"gs AS ({hecht_grid_sql()}), gt AS (SELECT t, i, m, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp) AS tp FROM gs GROUP BY 1, 2, 3), gm AS (SELECT *, {METRIC_SQL} FROM gt)"


def grid_totals(t):
    return with_metrics(sum_confusion(conf_hecht(t), *HP))


@query("a8_g2_summed_grid_metrics", f"WITH {EPOCHS_SQL}, {GRID_TOTALS} SELECT concat_ws('-', t, i, m) AS combo, {M6} FROM gm")
def _(t):
    return metrics6(grid_totals(t), parameter_key("t", "i", "m").alias("combo"))


@query("o1_best_combination", f"WITH {EPOCHS_SQL}, {GRID_TOTALS} SELECT t, i, m, {s6('f1', 'f1')} FROM gm ORDER BY round(f1, 9) DESC, t, i, m LIMIT 1")
def _(t):
    best = G.best_row(grid_totals(t).withColumn("_f", F.round("f1", 9)), "_f", [], HP)
    return best.select(*HP, r6("f1"))


@query("o2_best_with_ties", f"WITH {EPOCHS_SQL}, {GRID_TOTALS} SELECT t, i, m, {s6('recall', 'recall')} FROM gm QUALIFY rank() OVER (PARTITION BY t ORDER BY round(recall, 3) DESC) = 1")
def _(t):
    g = grid_totals(t).withColumn("_r", F.round("recall", 3))
    return G.best_with_ties(g, "_r", ["t"]).select(*HP, r6("recall"))


@query("o3_tied_parameter_ranges", f"""WITH {EPOCHS_SQL}, {GRID_TOTALS}, b AS (SELECT * FROM gm QUALIFY rank() OVER (PARTITION BY t ORDER BY round(recall, 2) DESC) = 1)
  SELECT t, CASE WHEN min(i) <> max(i) THEN concat(min(i), '--', max(i)) ELSE CAST(min(i) AS VARCHAR) END AS i,
    CASE WHEN min(m) <> max(m) THEN concat(min(m), '--', max(m)) ELSE CAST(min(m) AS VARCHAR) END AS m FROM b GROUP BY 1""")
def _(t):
    g = grid_totals(t).withColumn("_r", F.round("recall", 2))
    return G.tied_ranges(g, "_r", ["i", "m"], ["t"]).select("t", "i", "m")


@query("o4_sorted_results", f"WITH {EPOCHS_SQL}, {GRID_TOTALS} SELECT t, i, m, {s6('f1', 'f1')} FROM gm ORDER BY f1 DESC, t, i, m")
def _(t):
    return grid_totals(t).orderBy(F.desc("f1"), *HP).select(*HP, r6("f1"))


@query("o7_parameter_surfaces", f"""WITH {EPOCHS_SQL}, {GRID_TOTALS}
  SELECT 't_i' AS pair, CAST(t AS VARCHAR) AS v1, CAST(i AS VARCHAR) AS v2, {s6('f1', 'f1')} FROM gm WHERE m = 2
  UNION ALL SELECT 't_m', CAST(t AS VARCHAR), CAST(m AS VARCHAR), {s6('f1', 'f1')} FROM gm WHERE i = 20
  UNION ALL SELECT 'i_m', CAST(i AS VARCHAR), CAST(m AS VARCHAR), {s6('f1', 'f1')} FROM gm WHERE t = 5""")
def _(t):
    s = G.surfaces(grid_totals(t), HECHT_GRID, {"t": 5, "i": 20, "m": 2}, "f1")
    return s.select("pair", "v1", "v2", r6("f1"))


@query("v6_default_against_best", f"""WITH {EPOCHS_SQL}, {GRID_TOTALS}, b AS (SELECT * FROM gm ORDER BY round(f1, 9) DESC, t, i, m LIMIT 1), d AS (SELECT * FROM gm WHERE t = 5 AND i = 20 AND m = 2)
  {' UNION ALL '.join(f"SELECT '{m}' AS metric, round(d.{m}, 6) + 0.0 AS default_value, round(b.{m}, 6) + 0.0 AS best_value FROM b, d" for m in METRICS)}""")
def _(t):
    g = grid_totals(t).withColumn("f1", F.round("f1", 9))
    return reports.default_and_best(g, {"t": 5, "i": 20, "m": 2}, "f1").select("metric", r6("default_value"), r6("best_value"))


@query("v7_v8_scores_per_parameter_and_subject", f"""WITH {EPOCHS_SQL}, gs AS ({hecht_grid_sql()}), k AS (SELECT subject, tn, fp, fn, tp FROM gs WHERE t = 25 AND i = 20 AND m = 2)
  SELECT CAST(subject AS VARCHAR) AS scope, {M6} FROM (SELECT *, {METRIC_SQL} FROM k)
  UNION ALL SELECT 'total', {M6} FROM (SELECT *, {METRIC_SQL} FROM (SELECT sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp) AS tp FROM k))""")
def _(t):
    rows = conf_hecht(t).filter("t = 25 AND i = 20 AND m = 2")
    scope = F.explode(F.array(F.col("subject").cast("string"), F.lit("total"))).alias("scope")
    summed = sum_confusion(rows.select(scope, "tn", "fp", "fn", "tp"), "scope")
    return metrics6(with_metrics(summed), "scope")


@query("q3_heat_map_table", f"WITH {EPOCHS_SQL}, {GRID_TOTALS} SELECT i, {', '.join(s6(f'max(f1) FILTER (m = {m} AND t = 25)', f'm{m}') for m in (1, 2, 3))} FROM gm GROUP BY 1")
def _(t):
    h = reports.heat_map(grid_totals(t).filter("t = 25"), "i", "m", [1, 2, 3], "f1")
    return h.select("i", *[r6(str(m), f"m{m}") for m in (1, 2, 3)])


@query("q4_best_of_each_method", f"""WITH {EPOCHS_SQL}, {GRID_TOTALS}, ts AS ({troiano_grid_sql()}),
  tm AS (SELECT *, {METRIC_SQL} FROM (SELECT "at", mpl, st, ss, vm, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp) AS tp FROM ts GROUP BY ALL))
  SELECT 'hecht' AS method, {s6('max(f1)', 'f1')} FROM gm UNION ALL SELECT 'troiano', {s6('max(f1)', 'f1')} FROM tm""")
def _(t):
    tro = with_metrics(sum_confusion(conf_troiano(t), *TP_))
    return reports.best_of_each({"hecht": grid_totals(t), "troiano": tro}, "f1").select("method", r6("f1"))


# ---- cross-validation ------------------------------------------------------------------

def classes_sql(folds=3):
    return f"""
rn AS (SELECT subject, count(*) AS n FROM ({runs_sql('epochs', 'truth = 1')}) GROUP BY 1),
sb AS (SELECT s.subject, CASE WHEN coalesce(n, 0) <= 13 THEN 0 ELSE 1 END AS cls FROM (SELECT DISTINCT subject FROM epochs) s LEFT JOIN rn ON s.subject = rn.subject),
sp AS (SELECT *, row_number() OVER (ORDER BY subject) - 1 AS pos, count(*) OVER () AS n FROM sb),
pt AS (SELECT subject, cls, CASE WHEN pos < n - ceil(n * 0.3) THEN 'train' ELSE 'test' END AS part FROM sp),
fd AS (SELECT subject, cls, CAST(ntile({folds}) OVER (PARTITION BY cls ORDER BY subject) - 1 AS INTEGER) AS fold FROM pt WHERE part = 'train')"""


CLASSES = classes_sql()


def classed(t):
    runs = E.to_episodes(t.epochs, F.col("truth") == 1, "epoch_idx", ts=None, counter=False)
    counts = runs.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    # Thirteen runs stand in for one: every subject of the month has several.
    return t.epochs.select("subject").distinct().join(counts, "subject", "left").select(
        "subject", F.when(F.coalesce("n", F.lit(0)) <= 13, 0).otherwise(1).alias("cls"))


BLOCK = lambda: chunked.div("subject", 4096)


@query("m1_positional_split", f"WITH {EPOCHS_SQL}, {CLASSES} SELECT subject, part FROM pt")
def _(t):
    return cv.positional_split(classed(t), ["subject"], BLOCK()).select("subject", "part")


@query("m2_stratified_folds", f"WITH {EPOCHS_SQL}, {CLASSES} SELECT subject, cls, fold FROM fd")
def _(t):
    parts = cv.positional_split(classed(t), ["subject"], BLOCK())
    return cv.stratified_folds(parts.filter("part = 'train'"), ["subject"], BLOCK(), 3).select("subject", "cls", "fold")


@query("m2_plain_folds", "SELECT c_custkey AS subject, CAST(ntile(7) OVER (ORDER BY c_custkey) - 1 AS INTEGER) AS fold FROM customer")
def _(t):
    s = t.raw("customer").select(F.col("c_custkey").alias("subject"))
    return cv.plain_folds(s, ["subject"], BLOCK(), 7).select("subject", "fold")


def folds_sql(space=HECHT_GRID, folds=3):
    return f"""gs AS ({hecht_grid_sql(space)}), {classes_sql(folds)},
cf AS (SELECT g.*, fold FROM gs g JOIN fd ON g.subject = fd.subject),
te AS (SELECT fold, t, i, m, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp) AS tp FROM cf GROUP BY 1, 2, 3, 4),
tr0 AS (SELECT f.fold, c.t, c.i, c.m, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp) AS tp FROM cf c JOIN (SELECT DISTINCT fold FROM fd) f ON c.fold <> f.fold GROUP BY 1, 2, 3, 4),
bst AS (SELECT fold, t, i, m, f1 AS train_f1 FROM (SELECT *, {METRIC_SQL} FROM tr0) QUALIFY row_number() OVER (PARTITION BY fold ORDER BY coalesce(f1, -1) DESC, t, i, m) = 1),
fr AS (SELECT bst.train_f1, te.*, FROM bst JOIN te ON bst.fold = te.fold AND bst.t = te.t AND bst.i = te.i AND bst.m = te.m),
fm AS (SELECT *, {METRIC_SQL} FROM fr)"""


FOLDS = folds_sql()


def validated(t):
    return cv.cross_validate(conf_hecht(t), classed(t), ["subject"], BLOCK(), HP, folds=3)


@query("g4_fold_winners", f"WITH {EPOCHS_SQL}, {FOLDS} SELECT fold, t, i, m, {s6('train_f1', 'train_f1')}, {M6} FROM fm")
def _(t):
    return metrics6(validated(t)["folds"], "fold", *HP, r6("train_f1"))


@query("g4_hecht_whole_space_ten_folds", f"WITH {EPOCHS_SQL}, {folds_sql(HECHT_SPACE, 10)} SELECT fold, t, i, m, {s6('train_f1', 'train_f1')}, {M6} FROM fm")
def _(t):
    found = cv.cross_validate(G.hecht_grid(t.epochs, HECHT_SPACE), classed(t), ["subject"], BLOCK(), HP, folds=10)
    return metrics6(found["folds"], "fold", *HP, r6("train_f1"))


@query("g4_mean_of_test_folds", f"WITH {EPOCHS_SQL}, {FOLDS} SELECT {', '.join(s6(f'avg({m})', m) for m in METRICS)} FROM fm")
def _(t):
    return metrics6(validated(t)["training"])


@query("g4_held_out_score", f"""WITH {EPOCHS_SQL}, {FOLDS}, pk AS (SELECT t, i, m FROM fm ORDER BY coalesce(f1, -1) DESC, fold LIMIT 1),
  ho AS (SELECT g.t, g.i, g.m, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp) AS tp FROM gs g JOIN pk ON g.t = pk.t AND g.i = pk.i AND g.m = pk.m
    WHERE subject IN (SELECT subject FROM pt WHERE part = 'test') GROUP BY 1, 2, 3)
  SELECT t, i, m, {M6} FROM (SELECT *, {METRIC_SQL} FROM ho)""")
def _(t):
    return metrics6(validated(t)["test"], *HP)


@query("q1_cv_and_grid_table", f"""WITH {EPOCHS_SQL}, {GRID_TOTALS}, b AS (SELECT *, round(f1, 3) AS r FROM gm QUALIFY rank() OVER (ORDER BY round(f1, 3) DESC) = 1)
  SELECT 'hecht' AS method, CASE WHEN min(t) <> max(t) THEN concat(min(t), '--', max(t)) ELSE CAST(min(t) AS VARCHAR) END AS t,
    CASE WHEN min(i) <> max(i) THEN concat(min(i), '--', max(i)) ELSE CAST(min(i) AS VARCHAR) END AS i, '-' AS mpl, CAST(round(max(r), 3) AS DOUBLE) AS f1,
    printf('%.3f ± %.3f', max(r), round(1.96 * sqrt(max(r) * (1 - max(r)) / 583), 3)) AS f1_text FROM b""")
def _(t):
    g = grid_totals(t).withColumn("f1", F.round("f1", 3))
    top = G.tied_ranges(g, "f1", ["t", "i"])
    missing = F.lit(None).cast("string")
    from stillwave.functions.metrics import with_interval_text
    return top.select(F.lit("hecht").alias("method"), "t", "i", reports.merged_text(missing, missing).alias("mpl"), "f1",
                      with_interval_text("f1", 583).alias("f1_text"))


@query("q10_all_methods_on_one_timeline", f"""WITH {EPOCHS_SQL}, {MATRIX} SELECT e.subject, e.epoch_idx, e.axis1, lm.hecht, lm.troiano, lm.choi FROM epochs e JOIN lm ON e.subject = lm.subject AND e.epoch_idx = lm.epoch_idx""")
def _(t):
    nw = lambda df: df.select("subject", "epoch_idx", (1 - F.col("wear")).cast("long").alias("value"))
    return A.outer_timeline({
        "axis1": t.epochs.select("subject", "epoch_idx", F.col("axis1").alias("value")), "hecht": nw(hecht(t)),
        "troiano": nw(troiano(t)), "choi": nw(choi(t))}, ("subject", "epoch_idx"))


# ---- raw baselines and decision grids --------------------------------------------------

def raw_truth(t):
    return t.stored_signal.select("subject", "idx", F.when(F.col("y") == 0, 1).otherwise(0).alias("truth"))


BASELINE_SPACE = {"std": [0.1001, 0.1501, 0.2001, 0.2501], "length": [1, 2, 3, 4, 5, 6, 8, 10]}


@query("g5_v7_q2_baseline_grid", f"""WITH RECURSIVE {SIGNAL_SQL}, th(th) AS (VALUES {', '.join(f'({v}::DOUBLE)' for v in BASELINE_SPACE['std'])}),
  ln(len) AS (VALUES {', '.join(f'({v})' for v in BASELINE_SPACE['length'])}),
  cd AS (SELECT th, subject, idx // {MINUTE} AS block FROM signal, th GROUP BY 1, 2, 3 HAVING stddev_pop(y) <= th AND stddev_pop(x) <= th AND stddev_pop(z) <= th),
  isl AS (SELECT th, subject, min(block) AS b0, max(block) AS b1 FROM (SELECT *, block - row_number() OVER (PARTITION BY th, subject ORDER BY block) AS g FROM cd) GROUP BY th, subject, g),
  {grown_sql('th', 'th, ')},
  ep AS MATERIALIZED (SELECT th, len, subject, start_index AS a, stop_index - 1 AS b FROM un, ln WHERE stop_index > start_index AND (stop_index - 1 - start_index) // {MINUTE} >= len),
  sc AS (SELECT g.th, g.len, s.y = 0 AS y, ep.subject IS NOT NULL AS p FROM signal s CROSS JOIN (SELECT * FROM th, ln) g
     LEFT JOIN ep ON ep.th = g.th AND ep.len = g.len AND ep.subject = s.subject AND s.idx >= ep.a AND s.idx < ep.b)
  SELECT th AS std, len AS length, {cells('CAST(y AS INTEGER)', 'CAST(p AS INTEGER)')} FROM sc GROUP BY 1, 2""")
def _(t):
    # Fixed samples and the minute table once; thresholds and lengths only touch minutes and episodes.
    return models.baseline_grid(t.stored_signal, raw_truth(t), BASELINE_SPACE, samples_per_min=MINUTE)


# ---- prediction metrics ----------------------------------------------------------------

SCORES = "sc AS (SELECT doc_id, quality AS y, (hash_ % 20) / 20.0 AS s FROM (SELECT doc_id, quality, (doc_id * 7919 + toxic * 13) AS hash_ FROM labels))"


def scores(t):
    return t.raw("labels").select("doc_id", F.col("quality").alias("y"), ((F.col("doc_id") * 7919 + F.col("toxic") * 13) % 20 / 20.0).alias("s"))


ROC = f"""{SCORES}, g AS (SELECT s, sum(y) AS p, count(*) - sum(y) AS n FROM sc GROUP BY 1),
  c AS (SELECT s, sum(p) OVER w / sum(p) OVER () AS tpr, sum(n) OVER w / sum(n) OVER () AS fpr FROM g WINDOW w AS (ORDER BY s DESC))"""


@query("m11_roc_curve", f"WITH {ROC} SELECT {s6('CAST(s AS DOUBLE)', 'threshold')}, {s6('fpr', 'fpr')}, {s6('tpr', 'tpr')} FROM c")
def _(t):
    return models.roc_curve(scores(t), "y", "s").select(r6("threshold"), r6("fpr"), r6("tpr"))


@query("m11_roc_auc", f"""WITH {ROC} SELECT {s6('sum((fpr - coalesce(pf, 0)) * (tpr + coalesce(pt, 0)) / 2)', 'auc')}
  FROM (SELECT *, lag(fpr) OVER (ORDER BY s DESC) AS pf, lag(tpr) OVER (ORDER BY s DESC) AS pt FROM c)""")
def _(t):
    return models.roc_auc(models.roc_curve(scores(t), "y", "s")).select(r6("auc"))


@query("m11_precision_recall_support", f"""WITH p AS (SELECT quality AS y, toxic AS p FROM labels), k(label) AS (VALUES (0), (1)),
  c AS (SELECT label, count(*) FILTER (y = label AND p = label) AS tp, count(*) FILTER (p = label) AS pp, count(*) FILTER (y = label) AS support FROM p, k GROUP BY 1),
  m AS (SELECT label, support, tp / pp AS precision, tp / support AS recall, 2 * tp / (pp + support) AS f1 FROM c)
  SELECT CAST(label AS VARCHAR) AS label, support, {s6('precision', 'precision')}, {s6('recall', 'recall')}, {s6('f1', 'f1')} FROM m
  UNION ALL SELECT 'weighted', CAST(sum(support) AS BIGINT), {s6('sum(precision * support) / sum(support)', 'precision')}, {s6('sum(recall * support) / sum(support)', 'recall')},
    {s6('sum(f1 * support) / sum(support)', 'f1')} FROM m""")
def _(t):
    out = models.precision_recall(t.raw("labels"), "quality", "toxic")
    return out.select("label", "support", r6("precision"), r6("recall"), r6("f1"))


@query("m9_balance_classes", """WITH n AS (SELECT count(*) FILTER (quality = 0) AS n0, count(*) FILTER (quality = 1) AS n1 FROM labels)
  SELECT quality AS label, count(*) AS n FROM labels, n, range(1000) r(k) WHERE k < CASE WHEN (quality = 0) = (n0 < n1) THEN greatest(n0, n1) // least(n0, n1) ELSE 1 END GROUP BY 1""")
def _(t):
    out = models.balance(t.raw("labels").withColumnRenamed("quality", "label"), "label")
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("m10_positional_parts", """SELECT doc_id, CASE WHEN pos < floor(0.6 * n) THEN 'train' WHEN pos < floor(0.6 * n) + floor(0.2 * n) THEN 'dev' ELSE 'test' END AS part
  FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM labels)""")
def _(t):
    return models.positional_parts(t.raw("labels"), ["doc_id"], chunked.div("doc_id", 4096), 0.6, 0.2).select("doc_id", "part")


# ---- models (rows only: iterative training) --------------------------------------------

def feature_rows(t):
    from checks.relational import segment_rows
    from stillwave.operators.features import segment_features

    rows = segment_features(segment_rows(t), idx="epoch_idx", cell=16.0)
    return rows.withColumn("label", (F.col("counter") % 2).cast("double")).na.fill(0.0)


@query("x6_x7_m5_m6_m7_classifier_search")
def _(t):
    found = models.search(feature_rows(t), "logistic", folds=3, test_share=0.25, seed=42)
    return found["metrics"]


@query("m7_misclassified_segments")
def _(t):
    rows = feature_rows(t)
    model = models.fit(rows, "decision_tree")
    return models.misclassified(model, rows).select("subject", "counter", "label", "prediction")


@query("m3_split_seed_search")
def _(t):
    return models.split_seed_search(t.raw("labels").withColumnRenamed("quality", "label"), "doc_id", "label")


@query("m8_window_network")
def _(t):
    from checks.detect import candidate_episodes
    w = A.edge_windows(t.stored_signal, candidate_episodes(t).withColumn("label", (F.col("start_index") % 2).cast("int")), 6)
    return models.window_network(w, 6, epochs=5).select("part", "tn", "fp", "fn", "tp")


@query("e7_edge_classifier_decision")
def _(t):
    from checks.detect import candidate_episodes
    ep = candidate_episodes(t)
    w = A.edge_windows(t.stored_signal, ep.withColumn("label", (F.col("start_index") % 2).cast("int")), 6)
    model = models.fit_windows(w, 6, epochs=5)
    return models.edge_decision(t.stored_signal, ep.select("subject", "counter", "start_index", "stop_index"), model, 6, "or", True)


@query("g5_q2_edge_decision_grid")
def _(t):
    from checks.detect import EDGE_THR, HZ, candidate_episodes
    ep = candidate_episodes(t)
    w = A.edge_windows(t.stored_signal, ep.withColumn("label", (F.col("start_index") % 2).cast("int")), 6)
    model = models.fit_windows(w, 6, epochs=5)
    space = {"edge": [True, False], "op": ["or", "and"], "distance": [1, 2, 3, 4, 5]}
    out = models.edge_decision_grid(t.stored_signal, ep, raw_truth(t), model, 6, space, HZ, EDGE_THR, MINUTE)
    return out.orderBy(F.desc("f1"), "edge", "op", "distance")


HISTORY = """SELECT p_brand AS net, p_partkey AS epoch, p_size / 50 AS precision, (p_partkey % 97) / 97 AS recall,
    (p_partkey % 89) / 89 AS val_precision, (p_size % 7) / 7 AS val_recall FROM part"""


@query("q5_training_history_last_epoch", f"""WITH h AS ({HISTORY})
  SELECT net, epoch, {s6('CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END', 'f1')},
    {s6('CASE WHEN val_precision + val_recall > 0 THEN 2 * val_precision * val_recall / (val_precision + val_recall) END', 'val_f1')}
  FROM h QUALIFY row_number() OVER (PARTITION BY net ORDER BY epoch DESC) = 1""")
def _(t):
    c = F.col
    h = t.raw("part").select(
        c("p_brand").alias("net"), c("p_partkey").alias("epoch"), (c("p_size") / 50).alias("precision"),
        (c("p_partkey") % 97 / 97).alias("recall"), (c("p_partkey") % 89 / 89).alias("val_precision"), (c("p_size") % 7 / 7).alias("val_recall"))
    last = reports.last_epoch(reports.history_f1(h), ["net"])
    return last.select("net", "epoch", r6("f1"), r6("val_f1"))


@query("e6_two_sensor_true_nonwear")
def _(t):
    from checks.relational import segment_rows
    rows = feature_rows(t)
    model = models.fit(rows, "logistic")
    worn = E.to_episodes(t.epochs, F.col("truth") == 0, "epoch_idx", ts=None)
    fixes = t.raw("events").filter("event_type = 'error'").select(F.col("user_id").alias("subject"), (F.col("event_id") % 5).alias("counter"))
    return models.true_nonwear(worn, rows.drop("label"), model, fixes)
