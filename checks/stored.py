"""Tables that are written to the shared folder and read back, and the accessors on them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.detect import LABELLED, labelled
from checks.registry import query
from checks.tables import EPOCHS_SQL, MONTH_START_SEC
from stillwave.functions import expressions as X
from stillwave.functions.fixed_values import CHOI_SPACE, HECHT_SPACE, HEES_SPACE, TROIANO_SPACE
from stillwave.operators import align as A
from stillwave.session import shared_folder, spread_keys
from stillwave.sources import tables as S


def place(t) -> str:
    return f"{shared_folder(t.spark)}/stored-{uuid.uuid4().hex}"


@query("s7_s8_keep_or_overwrite", f"""WITH {EPOCHS_SQL} SELECT subject, epoch_idx AS idx,
  axis1 + CASE WHEN subject % 3 = 0 THEN 2 WHEN subject % 2 = 0 THEN 0 ELSE 1 END AS axis1 FROM epochs""")
def _(t):
    # Even subjects first; then all, which adds the others only; then every third one anew.
    path, rows = place(t), t.epochs.select("subject", F.col("epoch_idx").alias("idx"), "axis1")
    more = lambda n: rows.withColumn("axis1", F.col("axis1") + n)
    S.write_table(rows.filter("subject % 2 = 0"), path, buckets=16)
    S.write_table(more(1), path, buckets=16)
    S.write_table(more(2).filter("subject % 3 = 0"), path, overwrite=True, buckets=16)
    return S.read_table(t.spark, path).select("subject", "idx", "axis1")


@query("s8_stored_range_with_stride", f"WITH {EPOCHS_SQL} SELECT subject, epoch_idx AS idx, axis1 FROM epochs WHERE epoch_idx >= 24 AND epoch_idx < 600 AND (epoch_idx - 24) % 5 = 0")
def _(t):
    path = place(t)
    S.write_table(t.epochs.select("subject", F.col("epoch_idx").alias("idx"), "axis1"), path, buckets=16)
    return S.read_table(t.spark, path, start=24, stop=600, stride=5).select("subject", "idx", "axis1")


@query("s12_stored_epochs_with_time_axis", f"""WITH {EPOCHS_SQL} SELECT subject, epoch_idx, {MONTH_START_SEC} + subject % 28 * 86400 + 27000 + epoch_idx * 3600 AS sec, axis1 FROM epochs""")
def _(t):
    path = place(t)
    S.write_table(t.epochs.select("subject", "epoch_idx", "axis1"), path, idx="epoch_idx", buckets=16)
    day = F.lpad((F.col("subject") % 28 + 1).cast("string"), 2, "0")
    text = F.create_map(F.lit("Start Date"), F.concat(day, F.lit(".01.2024")), F.lit("Start Time"), F.lit("07:30:00"),
                        F.lit("Date Format"), F.lit("dd.MM.yyyy"))
    meta = S.subjects(t.epochs).withColumn("meta", text)
    out = S.load_epochs(t.spark, path, meta, 3600)
    return out.select("subject", "epoch_idx", F.unix_seconds("ts").alias("sec"), "axis1")


@query("s9_s10_episode_rows_as_csv", f"""WITH {EPOCHS_SQL}, ep AS ({LABELLED}) SELECT subject, counter, {MONTH_START_SEC} + start_index * 3600 AS start_sec,
  {MONTH_START_SEC} + stop_index * 3600 AS stop_sec, start_index, stop_index, CAST(counter % 2 AS INTEGER) AS label FROM ep""")
def _(t):
    path = place(t)
    at = lambda c: F.timestamp_seconds(MONTH_START_SEC + F.col(c) * 3600)
    ep = labelled(t).select("subject", "counter", at("start_index").alias("start"), at("stop_index").alias("stop"),
                            "start_index", "stop_index", (F.col("counter") % 2).cast("int").alias("label"))
    S.write_episodes(ep, path)
    kinds = dict(ep.dtypes)
    back = S.read_rows_csv(t.spark, path, ", ".join(f"{c} {kinds[c]}" for c in (
        "subject", "counter", "start", "stop", "start_index", "stop_index", "label")))
    return back.select("subject", "counter", F.unix_seconds("start").alias("start_sec"), F.unix_seconds("stop").alias("stop_sec"),
                       "start_index", "stop_index", "label")


@query("s9_wide_rows_as_pairs", """WITH c AS (SELECT c_nationkey AS nation, count(*) AS n, min(c_custkey) AS first, max(c_custkey) AS last FROM customer GROUP BY 1)
  SELECT nation, 'n' AS name, CAST(n AS VARCHAR) AS value FROM c UNION ALL SELECT nation, 'first', CAST(first AS VARCHAR) FROM c
  UNION ALL SELECT nation, 'last', CAST(last AS VARCHAR) FROM c""")
def _(t):
    path = place(t)
    wide = t.raw("customer").groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last"))
    S.write_pairs_csv(wide, path, ["n", "first", "last"])
    return S.read_rows_csv(t.spark, path, f"nation {dict(wide.dtypes)['nation']}, name string, value string", header=False)


@query("p8_flipped_labels", f"WITH {EPOCHS_SQL} SELECT subject, epoch_idx, 1 - truth AS wear FROM epochs")
def _(t):
    return t.epochs.select("subject", "epoch_idx", X.flip("truth").alias("wear"))


@query("g1_o5_parameter_spaces_per_subject", """WITH s AS (SELECT DISTINCT user_id AS subject FROM events)
  SELECT subject, method, n FROM s, (VALUES ('hecht', CAST(1100 AS BIGINT)), ('troiano', 9900), ('choi', 10500), ('hees', 5103)) v(method, n)""")
def _(t):
    # Different combinations that each subject gets; the results of the methods are one table.
    # Subjects are dealt before the combinations are made, so their rows are counted where they are made.
    subjects, out = spread_keys(S.subjects(t.epochs.select("subject")), ["subject"]), None
    for method, space in {"hecht": HECHT_SPACE, "troiano": TROIANO_SPACE, "choi": CHOI_SPACE, "hees": HEES_SPACE}.items():
        every = A.with_parameters(subjects, space).groupBy("subject", *space).agg(F.count(F.lit(1)).alias("times"))
        part = every.filter("times = 1").groupBy("subject").agg(F.count(F.lit(1)).alias("n")).select(
            "subject", F.lit(method).alias("method"), "n")
        out = part if out is None else out.unionByName(part)
    return out
