"""Projections, filters, joins, aggregations, time axes and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.detect import (
    CANDIDATES, EPISODES, HOUR, LABELLED, candidate_episodes, labelled, runs_sql,
)
from checks.registry import query, r6, s6
from checks.tables import EPOCHS_SQL, MONTH_START_SEC, SIGNAL_SQL
from stillwave.functions import expressions as X
from stillwave.functions.fixed_values import LONG_LABELS
from stillwave.functions.metrics import confusion
from stillwave.operators import align as A, axes as T, calibration as C, episodes as E, epochs as P, features as Z, statistics as ST
from stillwave.plans import reports


# ---- projections and scalar functions --------------------------------------------------

@query("p1_vector_magnitude", f"""WITH {SIGNAL_SQL}, v AS (SELECT *, sqrt(y * y + x * x + z * z) AS v FROM signal)
  SELECT subject, idx, {s6('v', 'vmu')}, {s6('v - 1', 'enmo')}, {s6('greatest(v - 1, 0)', 'enmo_clipped')} FROM v""")
def _(t):
    v = lambda **k: X.vector_magnitude("y", "x", "z", **k)
    return t.signal.select("subject", "idx", r6(v(), "vmu"), r6(v(minus_one=True), "enmo"),
                           r6(v(minus_one=True, clip=True), "enmo_clipped"))


WEIGHT_SQL = """weights AS (SELECT s_suppkey AS subject, CASE WHEN s_acctbal > 5000 THEN 1.25 ELSE 1.0 END AS t_y, 1.0 AS t_x,
    CASE WHEN s_acctbal > 5000 THEN 0.5 ELSE 1.0 END AS t_z, CASE WHEN s_acctbal > 5000 THEN 0.125 ELSE 0.0 END AS b_y, 0.0 AS b_x, 0.0 AS b_z FROM supplier)"""


def weights(t):
    text = F.when(F.col("s_acctbal") > 5000, F.create_map(
        F.lit("t_y"), F.lit("1.25"), F.lit("t_z"), F.lit("0.5"), F.lit("b_y"), F.lit("0.125"))).otherwise(
        F.create_map(F.lit("note"), F.lit("none")))
    return t.raw("supplier").select(F.col("s_suppkey").alias("subject"), text.alias("meta")).select(
        "subject", *X.parse_weights("meta"))


@query("p4_p5_c4_apply_calibration", f"""WITH {SIGNAL_SQL}, {WEIGHT_SQL}
  SELECT s.subject, s.idx, {s6('y * coalesce(t_y, 1) + coalesce(b_y, 0)', 'y')}, {s6('x * coalesce(t_x, 1) + coalesce(b_x, 0)', 'x')},
    {s6('z * coalesce(t_z, 1) + coalesce(b_z, 0)', 'z')} FROM signal s LEFT JOIN weights w ON s.subject = w.subject""")
def _(t):
    return X.calibrate(t.signal, weights(t)).select("subject", "idx", r6("y"), r6("x"), r6("z"))


@query("p2_j5_rescale_by_metadata", """SELECT l_suppkey AS subject, count(*) AS n, round(sum(CAST(l_quantity AS BIGINT) / scale), 6) + 0.0 AS total
  FROM (SELECT *, CASE WHEN s_acctbal > 5000 THEN 256.0 ELSE 512.0 END AS scale FROM supplier) s JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1""")
def _(t):
    meta = t.raw("supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 5000, 256.0).otherwise(512.0).alias("scale"))
    rows = t.raw("lineitem").join(meta, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.col("l_suppkey").alias("subject")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum(X.rescale("l_quantity", "scale")), "total"))


@query("p3_min_max_scale", f"""WITH {SIGNAL_SQL}, b AS (SELECT subject, min(y) AS lo, max(y) AS hi FROM signal GROUP BY 1)
  SELECT s.subject, s.idx, {s6('CASE WHEN hi > lo THEN 2 * (y - lo) / (hi - lo) - 1 END', 'y')} FROM signal s JOIN b ON s.subject = b.subject""")
def _(t):
    return X.min_max_scale(t.signal.select("subject", "idx", "y"), ["y"]).select("subject", "idx", r6("y"))


@query("p6_parse_dates_by_format", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) END AS start_sec FROM orders""")
def _(t):
    d = F.col("o_orderdate").cast("timestamp")
    fmt = F.element_at(F.array(F.lit("dd.MM.yyyy"), F.lit("M/d/yyyy"), F.lit("other")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    text = F.when(fmt == "dd.MM.yyyy", F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "M/d/yyyy"))
    rows = t.raw("orders").select("o_orderkey", text.alias("date"), F.date_format(d, "HH:mm:ss").alias("time"), fmt.alias("fmt"))
    return rows.select("o_orderkey", F.unix_seconds(X.parse_start("date", "time", "fmt")).alias("start_sec"))


@query("p7_decode_map_values", "SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def _(t):
    meta = F.create_map(F.lit("name"), F.encode("c_name", "UTF-8"), F.lit("segment"), F.encode("c_mktsegment", "UTF-8"))
    m = t.raw("customer").select("c_custkey", X.decode_map(meta).alias("m"))
    return m.select("c_custkey", F.col("m")["name"].alias("name"), F.col("m")["segment"].alias("segment"))


@query("p9_bmi_and_sex", f"""SELECT c_custkey AS subject, {s6('(50 + c_nationkey) / (1.5 * 1.5)', 'bmi')},
  CASE WHEN c_custkey % 2 = 1 THEN 'Male' ELSE 'Female' END AS sex FROM customer""")
def _(t):
    return t.raw("customer").select(
        F.col("c_custkey").alias("subject"), r6(X.bmi(50 + F.col("c_nationkey"), F.lit(150.0)), "bmi"),
        X.sex_label(F.col("c_custkey") % 2).alias("sex"))


_CODES = list(LONG_LABELS) + ["none"]


@query("p10_long_labels", "SELECT p_partkey, CASE p_partkey % {} {} END AS label FROM part".format(
    len(_CODES), " ".join(f"WHEN {i} THEN '{LONG_LABELS[c]}'" for i, c in enumerate(_CODES) if c in LONG_LABELS)))
def _(t):
    codes = F.array(*[F.lit(c) for c in _CODES])
    code = F.element_at(codes, (F.col("p_partkey") % len(_CODES) + 1).cast("int"))
    return t.raw("part").select("p_partkey", X.long_label(code).alias("label"))


@query("p11_significance_marks", r"""SELECT o_orderkey, CASE WHEN p < 0.001 THEN '$ \ddag$' WHEN p < 0.01 THEN '$ \dag$' WHEN p < 0.05 THEN '$ *$' ELSE '' END AS mark
  FROM (SELECT o_orderkey, o_totalprice / 1000000 AS p FROM orders)""")
def _(t):
    return t.raw("orders").select("o_orderkey", X.significance(F.col("o_totalprice") / 1000000).alias("mark"))


@query("p12_parameter_keys", "SELECT p_partkey, concat_ws('-', p_size, p_partkey) AS key, CAST(p_size AS VARCHAR) AS a, CAST(p_partkey AS VARCHAR) AS b FROM part")
def _(t):
    keyed = t.raw("part").select("p_partkey", X.parameter_key("p_size", "p_partkey").alias("key"))
    return keyed.select("p_partkey", "key", *X.split_key("key", ["a", "b"]))


# ---- filters ---------------------------------------------------------------------------

UNFIT = "SELECT user_id FROM events GROUP BY 1 HAVING max(value) > 250"


def unfit(t):
    return t.raw("events").groupBy(F.col("user_id").alias("subject")).agg(F.max("value").alias("m")).filter("m > 250")


@query("f1_exclude_subjects", f"SELECT user_id AS subject, count(*) AS n FROM events WHERE user_id NOT IN ({UNFIT}) GROUP BY 1")
def _(t):
    ev = t.raw("events").withColumnRenamed("user_id", "subject")
    return T.exclude(ev, unfit(t)).groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


@query("f2_a6_crop_to_bounds", """WITH b AS (SELECT user_id, min(ts) AS a, max(ts) AS z FROM events WHERE event_type = 'purchase' GROUP BY 1)
  SELECT e.event_id FROM events e JOIN b ON e.user_id = b.user_id WHERE e.ts BETWEEN a AND z""")
def _(t):
    ev = t.raw("events").withColumnRenamed("user_id", "subject")
    limits = P.bounds(ev.filter("event_type = 'purchase'"))
    return P.crop(ev, limits).select("event_id")


@query("a6_recording_bounds", "SELECT user_id AS subject, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS stop_us FROM events GROUP BY 1")
def _(t):
    b = P.bounds(t.raw("events").select(F.col("user_id").alias("subject"), F.col("ts").cast("timestamp").alias("ts")))
    return b.select("subject", F.unix_micros("start").alias("start_us"), F.unix_micros("stop").alias("stop_us"))


@query("f3_time_of_day", "SELECT event_id FROM events WHERE strftime(ts, '%H:%M:%S') BETWEEN '07:00:00' AND '23:00:00'")
def _(t):
    return t.raw("events").filter(X.in_daytime("ts")).select("event_id")


@query("f4_subject_slice", "SELECT DISTINCT user_id AS subject FROM events ORDER BY 1 LIMIT 7 OFFSET 3")
def _(t):
    return T.subject_slice(t.raw("events").select(F.col("user_id").alias("subject")), 3, 10)


@query("f5_drop_missing", f"""SELECT user_id AS subject, count(v) AS n, {s6('avg(v)', 'mean_v')} FROM
  (SELECT user_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events) WHERE v IS NOT NULL GROUP BY 1""")
def _(t):
    v = t.raw("events").select(F.col("user_id").alias("subject"), F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return v.dropna(subset=["v"]).groupBy("subject").agg(F.count("v").alias("n"), r6(F.avg("v"), "mean_v"))


@query("f6_j4_samples_in_episodes", f"""WITH RECURSIVE {SIGNAL_SQL}, {CANDIDATES}, {EPISODES}
  SELECT s.subject, e.counter, s.idx FROM signal s JOIN eps e ON s.subject = e.subject AND s.idx >= e.a AND s.idx < e.b""")
def _(t):
    return A.samples_in_episodes(t.stored_signal, candidate_episodes(t), closed=False, block_rows=64).select("subject", "counter", "idx")


@query("s4_slice_with_stride", f"WITH {SIGNAL_SQL} SELECT subject, idx, y FROM signal WHERE idx >= 100 AND idx < 2000 AND (idx - 100) % 7 = 0")
def _(t):
    return T.slice_rows(t.signal, 100, 2000, 7).select("subject", "idx", "y")


@query("s5_subjects_having_dataset", "SELECT DISTINCT user_id AS subject FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100)")
def _(t):
    ev = t.raw("events").withColumnRenamed("user_id", "subject")
    return T.having(ev.select("subject").distinct(), ev.filter("event_type = 'purchase' AND value > 100"))


@query("s6_datasets_per_subject", "SELECT user_id AS subject, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS datasets FROM events GROUP BY 1")
def _(t):
    from stillwave.sources.tables import dataset_list
    catalog = t.raw("events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("dataset"))
    return dataset_list(catalog).select("subject", F.array_join("datasets", ",").alias("datasets"))


@query("s8_merge_metadata", """SELECT coalesce(a.user_id, b.user_id) AS subject, CAST(coalesce(b.v, a.v) AS VARCHAR) AS level, CAST(a.n AS VARCHAR) AS clicks, CAST(b.n AS VARCHAR) AS errors
  FROM (SELECT user_id, min(event_id) AS v, count(*) AS n FROM events WHERE event_type = 'click' AND value > 100 GROUP BY 1) a
  FULL JOIN (SELECT user_id, max(event_id) AS v, count(*) AS n FROM events WHERE event_type = 'error' AND value > 100 GROUP BY 1) b ON a.user_id = b.user_id""")
def _(t):
    from stillwave.sources.tables import merge_metadata
    def meta(kind, level, name):
        g = t.raw("events").filter((F.col("event_type") == kind) & (F.col("value") > 100)).groupBy(F.col("user_id").alias("subject")).agg(
            level("event_id").alias("v"), F.count(F.lit(1)).alias("n"))
        return g.select("subject", F.lit("d").alias("dataset"), F.create_map(
            F.lit("level"), F.col("v").cast("string"), F.lit(name), F.col("n").cast("string")).alias("meta"))
    m = merge_metadata(meta("click", F.min, "clicks"), meta("error", F.max, "errors"))
    return m.select("subject", *[F.try_element_at("meta", F.lit(k)).alias(k) for k in ("level", "clicks", "errors")])


@query("s11_covariate_upsert", """WITH cov AS (SELECT c_custkey AS subject, CAST(CAST(round(c_acctbal) AS BIGINT) AS VARCHAR) AS age, c_mktsegment AS sex FROM customer WHERE c_acctbal > 0),
  s AS (SELECT user_id AS subject, event_type AS settingName, CAST(count(*) AS VARCHAR) AS settingValue FROM events GROUP BY 1, 2
        UNION ALL SELECT DISTINCT user_id, k, 'unset' FROM events, (VALUES ('age'), ('sex')) v(k))
  SELECT s.subject, s.settingName, CASE WHEN s.settingName = 'age' THEN cov.age WHEN s.settingName = 'sex' THEN cov.sex ELSE s.settingValue END AS settingValue
  FROM s JOIN cov ON s.subject = cov.subject""")
def _(t):
    from stillwave.sources.covariates import upsert_settings
    ev = t.raw("events").withColumnRenamed("user_id", "subject")
    present = ev.groupBy("subject", F.col("event_type").alias("settingName")).agg(F.count(F.lit(1)).cast("string").alias("settingValue"))
    blank = ev.select("subject").distinct().select(
        "subject", F.explode(F.array(F.lit("age"), F.lit("sex"))).alias("settingName"), F.lit("unset").alias("settingValue"))
    cov = t.raw("customer").select(
        F.col("c_custkey").alias("subject"), F.when(F.col("c_acctbal") > 0, F.round("c_acctbal").cast("long").cast("string")).otherwise("").alias("age"),
        F.col("c_mktsegment").alias("sex"))
    return upsert_settings(present.unionByName(blank), cov, ["age", "sex"])


# ---- joins -----------------------------------------------------------------------------

@query("j1_align_two_devices", f"""WITH {EPOCHS_SQL},
  a AS (SELECT subject, epoch_idx FROM epochs WHERE axis1 > 0), b AS (SELECT subject, epoch_idx FROM epochs WHERE b_counts > 0),
  lim AS (SELECT a.subject, s AS a_start, b0, b1 FROM (SELECT subject, min(epoch_idx) AS s FROM a GROUP BY 1) a
     JOIN (SELECT subject, min(epoch_idx) AS b0, max(epoch_idx) AS b1 FROM b GROUP BY 1) b ON a.subject = b.subject WHERE b1 >= s),
  sp AS (SELECT subject, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.subject = lim.subject AND b.epoch_idx = a_start) THEN a_start ELSE b0 END AS lo, b1 AS hi FROM lim)
  SELECT 'a' AS device, a.subject, a.epoch_idx FROM a JOIN sp ON a.subject = sp.subject WHERE a.epoch_idx >= lo AND a.epoch_idx < hi
  UNION ALL SELECT 'b', b.subject, b.epoch_idx FROM b JOIN sp ON b.subject = sp.subject WHERE b.epoch_idx >= lo AND b.epoch_idx < hi""")
def _(t):
    e = t.epochs.select("subject", "epoch_idx", "ts", "axis1", "b_counts")
    cut = A.align_devices(e.filter("axis1 > 0"), e.filter("b_counts > 0"))
    return cut["a"].select(F.lit("a").alias("device"), "subject", "epoch_idx").unionByName(
        cut["b"].select(F.lit("b").alias("device"), "subject", "epoch_idx"))


@query("j2_same_time_join", f"""WITH {EPOCHS_SQL} SELECT a.subject, a.epoch_idx, a.axis1 AS a, b.b_counts AS b, h.h_counts AS c
  FROM epochs a JOIN epochs b ON a.subject = b.subject AND a.epoch_idx = b.epoch_idx JOIN epochs h ON a.subject = h.subject AND a.epoch_idx = h.epoch_idx
  WHERE b.b_counts + a.axis1 > 0 AND h.h_counts = 0""")
def _(t):
    e = t.epochs
    out = A.segment_signals(
        e.select("subject", "epoch_idx", F.col("axis1").alias("a")),
        e.filter("b_counts + axis1 > 0").select("subject", "epoch_idx", F.col("b_counts").alias("b")),
        e.filter("h_counts = 0").select("subject", "epoch_idx", F.col("h_counts").alias("c")), ("subject", "epoch_idx"))
    return out.select("subject", "epoch_idx", "a", "b", "c")


@query("j3_full_outer_timeline", f"""WITH {EPOCHS_SQL},
  a AS (SELECT subject, epoch_idx, axis1 FROM epochs WHERE axis1 > 0), b AS (SELECT subject, epoch_idx, b_counts FROM epochs WHERE b_counts > 0),
  h AS (SELECT subject, epoch_idx, h_counts FROM epochs WHERE h_counts > 0)
  SELECT coalesce(ab.subject, h.subject) AS subject, coalesce(ab.epoch_idx, h.epoch_idx) AS epoch_idx, a, b, h_counts AS h
  FROM (SELECT coalesce(a.subject, b.subject) AS subject, coalesce(a.epoch_idx, b.epoch_idx) AS epoch_idx, axis1 AS a, b_counts AS b
        FROM a FULL JOIN b ON a.subject = b.subject AND a.epoch_idx = b.epoch_idx) ab
  FULL JOIN h ON ab.subject = h.subject AND ab.epoch_idx = h.epoch_idx""")
def _(t):
    part = lambda c: t.epochs.filter(f"{c} > 0").select("subject", "epoch_idx", F.col(c).alias("value"))
    return A.outer_timeline({"a": part("axis1"), "b": part("b_counts"), "h": part("h_counts")}, ("subject", "epoch_idx"))


@query("j6_semi_join_dataset", "SELECT c_custkey AS subject FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def _(t):
    return T.having(t.raw("customer").select(F.col("c_custkey").alias("subject")), t.raw("events").withColumnRenamed("user_id", "subject"))


@query("j7_anti_join_processed", "SELECT c_custkey AS subject FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def _(t):
    return T.exclude(t.raw("customer").select(F.col("c_custkey").alias("subject")), t.raw("events").withColumnRenamed("user_id", "subject"))


@query("j8_nearest_index_tolerance", f"""WITH RECURSIVE {SIGNAL_SQL}, {CANDIDATES}, {EPISODES}, tr AS (SELECT subject, idx FROM signal WHERE y > 0.7)
  SELECT e.subject, e.a AS idx, CAST(max(CASE WHEN tr.idx IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS is_true
  FROM eps e LEFT JOIN tr ON e.subject = tr.subject AND e.a BETWEEN tr.idx - 5 AND tr.idx + 4 GROUP BY 1, 2""")
def _(t):
    cand = candidate_episodes(t).select("subject", F.col("start_index").alias("idx"))
    return A.near_true(cand, t.stored_signal.filter("y > 0.7").select("subject", "idx"))


@query("j11_positional_clip_and_score", f"""WITH {EPOCHS_SQL}, p AS (SELECT subject, epoch_idx // 7 AS i, CASE WHEN sum(axis1) > 20 THEN 0 ELSE 1 END AS p FROM epochs GROUP BY 1, 2 HAVING count(*) = 7)
  SELECT e.subject, count(*) FILTER (truth = 0 AND p = 0) AS tn, count(*) FILTER (truth = 0 AND p = 1) AS fp, count(*) FILTER (truth = 1 AND p = 0) AS fn,
    count(*) FILTER (truth = 1 AND p = 1) AS tp FROM epochs e JOIN p ON e.subject = p.subject AND e.epoch_idx = p.i GROUP BY 1""")
def _(t):
    pred = P.roll_up(t.epochs, 1, 7, ["axis1"]).select("subject", "epoch_idx", F.when(F.col("axis1") > 20, 0).otherwise(1).alias("p"))
    joined = t.epochs.select("subject", "epoch_idx", "truth").join(pred, ["subject", "epoch_idx"])
    return joined.groupBy("subject").agg(*confusion("truth", "p"))


@query("j12_data_by_parameters", f"""WITH {EPOCHS_SQL} SELECT subject, t, m, count(*) FILTER (vmu > t) AS active FROM epochs, (VALUES (5), (10), (25), (50)) a(t), (VALUES (1), (2)) b(m) GROUP BY ALL""")
def _(t):
    rows = A.with_parameters(t.epochs.select("subject", "vmu"), {"t": [5, 10, 25, 50], "m": [1, 2]})
    return rows.groupBy("subject", "t", "m").agg(F.count_if(F.col("vmu") > F.col("t")).alias("active"))


# ---- aggregations ----------------------------------------------------------------------

@query("a1_a2_epoch_roll_up", f"""WITH {EPOCHS_SQL} SELECT subject, epoch_idx // 7 AS epoch_idx, CAST(sum(axis1) AS BIGINT) AS axis1, CAST(sum(axis2) AS BIGINT) AS axis2,
  CAST(sum(axis3) AS BIGINT) AS axis3, CAST(sum(steps) AS BIGINT) AS steps, {MONTH_START_SEC} + min(epoch_idx) * {HOUR} AS ts_sec, 7 AS epoch_sec
  FROM epochs GROUP BY subject, epoch_idx // 7 HAVING count(*) = 7""")
def _(t):
    e = P.roll_up(t.epochs, 1, 7)
    return e.select("subject", "epoch_idx", "axis1", "axis2", "axis3", "steps", F.unix_seconds("ts").alias("ts_sec"), "epoch_sec")


@query("a3_many_epoch_lengths", f"""WITH {EPOCHS_SQL} SELECT subject, k AS epoch_sec, epoch_idx // k AS epoch_idx, CAST(sum(axis1) AS BIGINT) AS axis1, CAST(sum(axis2) AS BIGINT) AS axis2
  FROM epochs, (VALUES (10), (20), (30), (40), (50), (60)) v(k) GROUP BY subject, k, epoch_idx // k HAVING count(*) = k""")
def _(t):
    return P.roll_up_many(t.epochs, 1, [10, 20, 30, 40, 50, 60], ["axis1", "axis2"], ts=None).select(
        "subject", "epoch_sec", "epoch_idx", "axis1", "axis2")


@query("a9_participant_descriptives", f"""WITH c AS (SELECT c_acctbal AS age, CAST(c_nationkey AS DOUBLE) AS height FROM customer),
  l AS (SELECT 'age' AS name, age AS v FROM c UNION ALL SELECT 'height', height FROM c)
  SELECT name, count(*) AS n, min(v) AS min, max(v) AS max, {s6('avg(v)', 'mean')}, {s6('stddev_samp(v)', 'sd')} FROM l GROUP BY 1""")
def _(t):
    d = ST.describe(t.raw("customer").select(F.col("c_acctbal").alias("age"), F.col("c_nationkey").alias("height")), ["age", "height"])
    return d.select("name", "n", "min", "max", r6("mean"), r6("sd"))


@query("a9_sex_share", f"SELECT n_name, count(*) AS n, count(*) FILTER (c_custkey % 2 = 1) AS males, {s6('count(*) FILTER (c_custkey % 2 = 1) / count(*)', 'share')} FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(t):
    c = t.raw("customer").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    male = X.sex_label(F.col("c_custkey") % 2) == "Male"
    return c.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(male).alias("males"),
                                   r6(F.count_if(male) / F.count(F.lit(1)), "share"))


@query("a10_recording_length", f"""WITH h AS (SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000 AS hours FROM events GROUP BY 1)
  SELECT count(*) AS n, {s6('min(hours)', 'min')}, {s6('max(hours)', 'max')}, {s6('avg(hours)', 'mean')}, {s6('stddev_pop(hours)', 'sd')} FROM h""")
def _(t):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    hours = t.raw("events").groupBy("user_id").agg(((F.max(us) - F.min(us)) / 3600000000).alias("hours"))
    d = ST.describe(hours, ["hours"], population=True)
    return d.select("n", r6("min"), r6("max"), r6("mean"), r6("sd"))


@query("a11_mean_without_nan", f"SELECT c_nationkey, {s6('avg(CASE WHEN c_acctbal >= 1000 THEN c_acctbal END)', 'mean')} FROM customer GROUP BY 1")
def _(t):
    v = F.when(F.col("c_acctbal") >= 1000, F.col("c_acctbal")).otherwise(F.lit(float("nan")))
    return t.raw("customer").groupBy("c_nationkey").agg(r6(ST.mean_without_nan(v), "mean"))


EDGES = [1, 5, 10, 20, 40, 60]


@query("a12_length_histogram", f"""WITH {EPOCHS_SQL}, l AS (SELECT n AS length FROM ({runs_sql('epochs', 'truth = 1')})),
  b AS (SELECT CAST(i - 1 AS INTEGER) AS bin, CAST(e[i] AS DOUBLE) AS low, CAST(e[i + 1] AS DOUBLE) AS high, i = 5 AS final FROM (SELECT {EDGES} AS e), range(1, 6) r(i))
  SELECT bin, low, high, count(length) AS n FROM b LEFT JOIN l ON length >= low AND (length < high OR (final AND length = high)) GROUP BY 1, 2, 3""")
def _(t):
    ep = E.to_episodes(t.epochs, F.col("truth") == 1, "epoch_idx", ts=None, counter=False)
    return ST.histogram(E.durations(ep, 1), "length", EDGES)


@query("a13_sequence_classes", f"""WITH {EPOCHS_SQL}, r AS (SELECT subject, count(*) AS n FROM ({runs_sql('epochs', 'truth = 1')}) GROUP BY 1)
  SELECT CAST(CASE WHEN coalesce(n, 0) <= 13 THEN 0 ELSE 1 END AS INTEGER) AS cls, count(*) AS subjects
  FROM (SELECT DISTINCT subject FROM epochs) s LEFT JOIN r ON s.subject = r.subject GROUP BY 1""")
def _(t):
    # Thirteen stands in for one: every subject of the month has several runs.
    runs = E.to_episodes(t.epochs, F.col("truth") == 1, "epoch_idx", ts=None, counter=False)
    counts = runs.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    cls = t.epochs.select("subject").distinct().join(counts, "subject", "left").select(
        F.when(F.coalesce("n", F.lit(0)) <= 13, 0).otherwise(1).alias("cls"))
    return cls.groupBy("cls").agg(F.count(F.lit(1)).alias("subjects"))


# ---- time axes and rate conversion -----------------------------------------------------

@query("r1_regular_time_axis", "SELECT c_custkey AS subject, 1704067200 + c_custkey * 10 AS ts_sec FROM customer")
def _(t):
    start = F.timestamp_seconds(F.lit(MONTH_START_SEC))
    return t.raw("customer").select(F.col("c_custkey").alias("subject"), F.unix_seconds(T.regular_time(start, "c_custkey", 10)).alias("ts_sec"))


@query("r2_subsecond_time_axis", f"WITH {SIGNAL_SQL} SELECT subject, idx, ({MONTH_START_SEC} + idx // 5) * 1000 + (idx % 5) * 200 AS ts_ms, y * 2 AS y FROM signal")
def _(t):
    bronze = t.signal.groupBy("subject", (F.expr("idx div 5") + MONTH_START_SEC).alias("sec")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "y", "x", "z"))).alias("w")).select(
        "subject", "sec", *[F.col(f"w.{a}").alias(a) for a in ("y", "x", "z")])
    out = T.explode_seconds(bronze, 5, F.lit(0.5))
    return out.select("subject", "idx", F.unix_millis("ts").alias("ts_ms"), "y")


@query("r3_device_time_axis", f"WITH {SIGNAL_SQL} SELECT subject, idx, {MONTH_START_SEC * 1_000_000} + idx * 1000000 // 128 AS ts_us FROM signal")
def _(t):
    start = F.timestamp_seconds(F.lit(MONTH_START_SEC))
    return t.signal.select("subject", "idx", F.unix_micros(T.sample_time(start, "idx", 128)).alias("ts_us"))


@query("r4_downsample_stride", f"WITH {SIGNAL_SQL} SELECT subject, idx // 60 AS idx, y FROM signal WHERE idx % 60 = 0")
def _(t):
    return T.downsample(t.signal, 60).select("subject", "idx", "y")


@query("r5_upsample_repeat", f"""WITH {EPOCHS_SQL} SELECT subject, i * 7 + k AS epoch_idx, axis1 FROM (
  SELECT subject, epoch_idx // 7 AS i, CAST(sum(axis1) AS BIGINT) AS axis1 FROM epochs GROUP BY 1, 2 HAVING count(*) = 7), range(7) r(k)""")
def _(t):
    return T.upsample(P.roll_up(t.epochs, 1, 7, ["axis1"], ts=None), 7, "epoch_idx").select("subject", "epoch_idx", "axis1")


def _weighted(col):
    """Order-sensitive digest of an array: sum of position times value."""
    return F.aggregate(F.transform("w", lambda s, i: s[col] * (i + 1)), F.lit(0.0), lambda a, v: a + v)


@query("r8_fixed_windows_in_episodes", f"""WITH RECURSIVE {SIGNAL_SQL}, {CANDIDATES}, {EPISODES},
  r AS (SELECT e.subject, e.counter, (idx - a) // 6 AS win, (idx - a) % 6 + 1 AS pos, y, z FROM signal s JOIN eps e ON s.subject = e.subject AND idx BETWEEN a AND b)
  SELECT subject, counter, win, {s6('sum(pos * y)', 'y_digest')}, {s6('sum(pos * z)', 'z_digest')} FROM r GROUP BY 1, 2, 3 HAVING count(*) = 6""")
def _(t):
    joined = A.samples_in_episodes(t.stored_signal, candidate_episodes(t), block_rows=64)
    w = A.fixed_windows(joined, 6, ["y", "x", "z"], keys=("subject", "counter"))
    return w.select("subject", "counter", "win", r6(_weighted("y"), "y_digest"), r6(_weighted("z"), "z_digest"))


@query("r9_edge_windows", f"""WITH RECURSIVE {SIGNAL_SQL}, {CANDIDATES}, {EPISODES},
  sp AS (SELECT subject, counter, 'start' AS side, a - 8 AS lo FROM eps WHERE a >= 8 UNION ALL SELECT subject, counter, 'stop', b FROM eps)
  SELECT sp.subject, sp.counter, sp.side, {s6('sum((idx - lo + 1) * y)', 'y_digest')}, {s6('sum((idx - lo + 1) * x)', 'x_digest')}
  FROM sp JOIN signal s ON s.subject = sp.subject AND s.idx >= lo AND s.idx < lo + 8 GROUP BY 1, 2, 3 HAVING count(*) = 8""")
def _(t):
    w = A.edge_windows(t.stored_signal, candidate_episodes(t), 8)
    return w.select("subject", "counter", "side", r6(_weighted("y"), "y_digest"), r6(_weighted("x"), "x_digest"))


# ---- calibration -----------------------------------------------------------------------

POINTS = f"""
seg AS (SELECT subject, idx // 10 AS segment, count(*) AS n, sum(y) AS sy, sum(x) AS sx, sum(z) AS sz,
    arg_min(y, idx) AS fy, arg_max(y, idx) AS ly, arg_min(x, idx) AS fx, arg_max(x, idx) AS lx, arg_min(z, idx) AS fz, arg_max(z, idx) AS lz
  FROM signal GROUP BY 1, 2 HAVING stddev_pop(y) <= 0.2501 AND stddev_pop(x) <= 0.2501 AND stddev_pop(z) <= 0.2501),
pts AS (SELECT subject, segment, (2 * sy - fy - ly) / (2 * (n - 1)) AS y, (2 * sx - fx - lx) / (2 * (n - 1)) AS x, (2 * sz - fz - lz) / (2 * (n - 1)) AS z FROM seg)"""


def points(t):
    return C.stationary_means(t.signal, 0.2501, 10)


@query("c1_stationary_means", f"WITH {SIGNAL_SQL}, {POINTS} SELECT subject, segment, {s6('y', 'y')}, {s6('x', 'x')}, {s6('z', 'z')} FROM pts")
def _(t):
    return points(t).select("subject", "segment", r6("y"), r6("x"), r6("z"))


@query("c3_sparsity_gate", f"""WITH {SIGNAL_SQL}, {POINTS} SELECT subject, count(*) AS points,
  (max(y) > 0.12 OR max(x) > 0.12 OR max(z) > 0.12) AND (min(y) < 0.01 OR min(x) < 0.01 OR min(z) < 0.01) AS fit_any,
  (max(y) > 0.12 AND max(x) > 0.12 AND max(z) > 0.12) AND (min(y) < 0.01 OR min(x) < 0.01 OR min(z) < 0.01) AS fit_all FROM pts GROUP BY 1""")
def _(t):
    p = points(t)
    any_axis = C.sparsity_gate(p, high=0.12, low=0.01).withColumnRenamed("fit", "fit_any")
    all_axes = C.sparsity_gate(p, high=0.12, low=0.01, high_all_axes=True).select("subject", F.col("fit").alias("fit_all"))
    return any_axis.join(all_axes, "subject")


@query("c2_fitted_weights")
def _(t):
    return C.calibration_weights(points(t), rounds=4)


# ---- features --------------------------------------------------------------------------

def segment_rows(t):
    """Signals a, b, c of both devices inside labelled episodes (closed)."""
    e = t.epochs.select("subject", "epoch_idx", F.col("axis1").alias("a"), F.col("b_counts").alias("b"), F.col("h_counts").alias("c"))
    worn = E.to_episodes(t.epochs, F.col("truth") == 0, "epoch_idx", ts=None)
    return A.samples_in_episodes(e, worn.select("subject", "counter", "start_index", "stop_index"), "epoch_idx", block_rows=64)


SEGMENTS = f"""
seg AS (SELECT subject, start_index, stop_index, row_number() OVER (PARTITION BY subject ORDER BY start_index) - 1 AS counter FROM ({runs_sql('epochs', 'truth = 0')})),
rws AS (SELECT s.subject, s.counter, e.epoch_idx, CAST(e.axis1 AS DOUBLE) AS a, CAST(e.b_counts AS DOUBLE) AS b, CAST(e.h_counts AS DOUBLE) AS c
  FROM seg s JOIN epochs e ON s.subject = e.subject AND e.epoch_idx BETWEEN start_index AND stop_index)"""
KEOGH = """
kg AS (SELECT subject, counter, sqrt(sum(CASE WHEN b > hi THEN (b - hi) * (b - hi) WHEN b < lo THEN (lo - b) * (lo - b) ELSE 0 END)) AS lb FROM (
  SELECT subject, counter, b, max(a) OVER w AS hi, min(a) OVER w AS lo FROM rws WINDOW w AS (PARTITION BY subject, counter ORDER BY epoch_idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) GROUP BY 1, 2)"""


def _feature_sql():
    lines, outs = [], []
    for s in "abc":
        lines += [f"stddev_pop({s}) AS {s}_std", f"avg({s}) AS {s}_mean", f"min({s}) AS {s}_min", f"max({s}) AS {s}_max",
                  f"CASE WHEN stddev_pop({s}) = 0 THEN NULL ELSE kurtosis_pop({s}) END AS {s}_kur",
                  f"CASE WHEN stddev_pop({s}) = 0 THEN 0 ELSE avg({s}) / stddev_pop({s}) END AS {s}_signal_to_noise",
                  f"median({s}) AS {s}_median", f"max({s}) - min({s}) AS {s}_ptp", f"var_pop({s}) AS {s}_var"]
    mode_cte = ", ".join(
        f"md_{s} AS (SELECT subject, counter, arg_max({s}, k * 1000000.0 - {s}) AS {s}_mode FROM (SELECT subject, counter, {s}, count(*) AS k FROM rws GROUP BY 1, 2, 3) GROUP BY 1, 2)" for s in "abc")
    for f in Z.FEATURES[:-1]:
        sig, stat = f.split("_", 1) if not f.startswith("ab_diff") else ("ab_diff", f[8:])
        outs.append(s6(f if sig != "ab_diff" else f"b_{stat} - a_{stat}", f))
    return f"""WITH {EPOCHS_SQL}, {SEGMENTS}, {KEOGH}, {mode_cte},
  st AS (SELECT subject, counter, {', '.join(lines)} FROM rws GROUP BY 1, 2)
  SELECT st.subject, st.counter, {', '.join(outs)}, {s6('lb', 'ab_dtw_1')}
  FROM st JOIN kg USING (subject, counter) JOIN md_a USING (subject, counter) JOIN md_b USING (subject, counter) JOIN md_c USING (subject, counter)"""


@query("x1_x2_x5_segment_features", _feature_sql())
def _(t):
    f = Z.segment_features(segment_rows(t), idx="epoch_idx", cell=16.0)
    return f.select("subject", "counter", *[r6(c) for c in Z.FEATURES])


@query("x3_lb_keogh_bound", f"WITH {EPOCHS_SQL}, {SEGMENTS}, {KEOGH} SELECT subject, counter, {s6('lb', 'lb_keogh')} FROM kg")
def _(t):
    return Z.keogh_bound(segment_rows(t), "b", "a", 1, idx="epoch_idx").select("subject", "counter", r6("lb_keogh"))


@query("x4_euclidean_distance", f"WITH {EPOCHS_SQL}, {SEGMENTS} SELECT subject, counter, {s6('sqrt(sum((a - b) * (a - b)))', 'distance')} FROM rws GROUP BY 1, 2")
def _(t):
    return Z.euclidean_distance(segment_rows(t), "a", "b").select("subject", "counter", r6("distance"))


PAIRS = """p AS (SELECT a.vec_id, unnest(range(1, 65)) AS i, unnest(a.embedding) AS u, unnest(b.embedding) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


@query("x3_x4_array_distances", f"""WITH {PAIRS}, e AS (SELECT vec_id, CAST(u AS DOUBLE) AS u, CAST(v AS DOUBLE) AS v,
    max(v) OVER w AS hi, min(v) OVER w AS lo FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING))
  SELECT vec_id, {s6('sqrt(sum((u - v) * (u - v)))', 'distance')},
    {s6('sqrt(sum(CASE WHEN u > hi THEN (u - hi) * (u - hi) WHEN u < lo THEN (lo - u) * (lo - u) ELSE 0 END))', 'lb_keogh')} FROM e GROUP BY 1""")
def _(t):
    e = t.raw("embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("u"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("u").alias("v")), "vec_id")
    return pairs.select("vec_id", r6(Z.array_distance(F.col("u"), F.col("v")), "distance"),
                        r6(Z.array_keogh_bound(F.col("u"), F.col("v"), 3), "lb_keogh"))


# ---- two-sample tests ------------------------------------------------------------------

LEVENE = """WITH g AS (SELECT event_type, value, median(value) OVER (PARTITION BY event_type) AS md FROM events WHERE event_type IN ('click', 'view')),
  z AS (SELECT event_type, abs(value - md) AS z FROM g),
  s AS (SELECT event_type, count(*) AS n, avg(z) AS m, var_pop(z) AS v FROM z GROUP BY 1), a AS (SELECT avg(z) AS zm, count(*) AS n FROM z)"""


@query("x8_levene_statistic", f"{LEVENE} SELECT {s6('(max(a.n) - 2) * sum(s.n * (m - zm) * (m - zm)) / sum(s.n * v)', 'w')}, 1.0::DOUBLE AS df1, CAST(max(a.n) - 2 AS DOUBLE) AS df2 FROM s, a")
def _(t):
    ev = t.raw("events").filter(F.col("event_type").isin("click", "view"))
    return ST.levene(ev, "event_type", "value").select(r6("w"), "df1", "df2")


def _t_sql(scale, freedom):
    return f"""WITH s AS (SELECT count(value) FILTER (event_type = 'click') AS n1, count(value) FILTER (event_type = 'view') AS n2,
    avg(value) FILTER (event_type = 'click') AS m1, avg(value) FILTER (event_type = 'view') AS m2,
    var_samp(value) FILTER (event_type = 'click') AS v1, var_samp(value) FILTER (event_type = 'view') AS v2 FROM events)
  SELECT {s6(f'(m1 - m2) / sqrt({scale})', 't')}, {s6(f'CAST({freedom} AS DOUBLE)', 'df')} FROM s"""


@query("x9_t_test_pooled", _t_sql("((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)", "n1 + n2 - 2"))
def _(t):
    return ST.t_test(t.raw("events"), "event_type", "click", "view", "value").select(r6("t"), r6("df"))


@query("x9_t_test_welch", _t_sql("v1 / n1 + v2 / n2", "(v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / (v1 / n1 * v1 / n1 / (n1 - 1) + v2 / n2 * v2 / n2 / (n2 - 1))"))
def _(t):
    return ST.t_test(t.raw("events"), "event_type", "click", "view", "value", equal_var=False).select(r6("t"), r6("df"))


@query("x8_x9_p_values")
def _(t):
    ev = t.raw("events")
    lev = ST.levene(ev.filter(F.col("event_type").isin("click", "view")), "event_type", "value")
    t1 = ST.t_test(ev, "event_type", "click", "view", "value")
    return lev.select(F.lit("levene").alias("test"), r6(ST.f_tail("w", "df1", "df2"), "p")).unionByName(
        t1.select(F.lit("t").alias("test"), r6(ST.t_two_sided("t", "df"), "p"))).select(
        "test", "p", X.significance("p").alias("mark"))


# ---- report extracts -------------------------------------------------------------------

@query("q7_per_day_split", f"""WITH {EPOCHS_SQL} SELECT subject, epoch_idx // 24 AS day_no, count(*) AS n, CAST(sum(axis1) AS BIGINT) AS axis1 FROM epochs GROUP BY 1, 2""")
def _(t):
    d = reports.per_day(t.epochs, ["axis1"])
    return d.select("subject", F.date_diff("day", F.lit("2024-01-01").cast("date")).cast("long").alias("day_no"), "n", "axis1")


@query("q8_thinned_nonwear_rows", f"""WITH {EPOCHS_SQL} SELECT subject, epoch_idx, axis1 FROM (
  SELECT *, row_number() OVER (PARTITION BY subject ORDER BY epoch_idx) - 1 AS rn FROM epochs WHERE truth = 1) WHERE rn % 10 = 0""")
def _(t):
    from stillwave.operators.chunked import div, row_index
    rows = row_index(t.epochs.filter("truth = 1"), ["subject"], ["epoch_idx"], div("epoch_idx", 65_536), "_rn")
    return rows.filter("_rn % 10 = 0").select("subject", "epoch_idx", "axis1")


@query("q9_scenario_extract", f"""WITH {EPOCHS_SQL} SELECT subject, epoch_idx, CASE WHEN axis1 > 0 THEN axis1 END AS a, CASE WHEN b_counts > 0 THEN b_counts END AS b
  FROM epochs WHERE (axis1 > 0 OR b_counts > 0) AND epoch_idx % 24 BETWEEN 8 AND 19 AND subject IN (SELECT user_id FROM events WHERE value > 250)""")
def _(t):
    part = lambda c: t.epochs.filter(f"{c} > 0").select("subject", "ts", F.col(c).alias("value"))
    line = A.outer_timeline({"a": part("axis1"), "b": part("b_counts")})
    out = reports.scenario(line, unfit(t), "08:00:00", "19:59:59")
    return out.select("subject", F.expr(f"(unix_seconds(ts) - {MONTH_START_SEC}) div {HOUR}").alias("epoch_idx"), "a", "b")


@query("q11_original_and_merged_episodes", f"""WITH {EPOCHS_SQL}, ep AS ({LABELLED}) SELECT 'original' AS source, subject, CAST(counter AS VARCHAR) AS counter, start_index, stop_index FROM ep
  UNION ALL SELECT 'merged', subject, counter, start_index, stop_index FROM (
  SELECT subject, CASE WHEN min(counter) = max(counter) THEN CAST(min(counter) AS VARCHAR) ELSE concat(min(counter), '-', max(counter)) END AS counter, min(start_index) AS start_index, max(stop_index) AS stop_index
  FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 13 THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY start_index) AS ses
    FROM (SELECT *, start_index - lag(stop_index) OVER (PARTITION BY subject ORDER BY start_index) AS gap FROM ep)) GROUP BY subject, ses)""")
def _(t):
    ep = labelled(t)
    merged = E.group_near(ep, 10, 3, samples_per_min=1)
    cols = ["subject", "counter", "start_index", "stop_index"]
    return ep.withColumn("counter", F.col("counter").cast("string")).select(F.lit("original").alias("source"), *cols).unionByName(
        merged.select(F.lit("merged").alias("source"), *cols))


@query("q6_lively_edge_windows", f"""WITH RECURSIVE {SIGNAL_SQL}, {CANDIDATES}, {EPISODES},
  sp AS (SELECT subject, counter, 'start' AS side, a - 8 AS lo FROM eps WHERE a >= 8 UNION ALL SELECT subject, counter, 'stop', b FROM eps)
  SELECT sp.subject, sp.counter, sp.side, {s6('stddev_pop(y)', 'std_y')} FROM sp JOIN signal s ON s.subject = sp.subject AND s.idx >= lo AND s.idx < lo + 8
  GROUP BY 1, 2, 3 HAVING count(*) = 8 AND stddev_pop(y) > 0.1001 AND stddev_pop(x) > 0.1001 AND stddev_pop(z) > 0.1001""")
def _(t):
    w = reports.lively_edges(t.stored_signal, candidate_episodes(t), 8, 0.1001)
    return w.select("subject", "counter", "side", r6("std_y"))
