"""Canonical sensor tables derived from the given tables, with the same rules in SQL.

* ``epochs``: user activity per hour on the 720-hour grid of the month.
  axis1 = clicks and views, axis2 = purchases, axis3 = views (whole units),
  steps = number of events. ``truth`` is 1 (not worn) when the second device
  (error and signup events) is silent for eight hours on both sides.
* ``signal``: shipped quantity, discount and tax per supplier and day on the
  2,500-day calendar, zero on idle days. Divisors are powers of two, so sums
  are exact in any order.

The calendars bound the rows per subject, however many rows a subject has in
the source: a busy user or supplier is folded by the map-side aggregation.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from stillwave.session import ROWS_PER_TASK, plan_by_measure, stash

HOURS = 720
DAYS = 2500
FIRST_DAY = "1995-01-02"
MONTH_START_SEC = 1_704_067_200
MINUTE = 5  # samples per "minute" of the daily signal

EPOCHS_SQL = f"""
hourly AS (
  SELECT user_id AS subject, epoch_us(ts) // 3600000000 - {MONTH_START_SEC // 3600} AS epoch_idx,
    sum(CASE WHEN event_type IN ('click', 'view') THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS c1,
    sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS c2,
    sum(CASE WHEN event_type = 'view' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS c3,
    sum(CASE WHEN event_type = 'error' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS cb,
    sum(CASE WHEN event_type = 'signup' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS ch,
    sum(CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 0 END) AS nb,
    count(*) AS n
  FROM events GROUP BY 1, 2),
grid AS (
  SELECT u.subject, CAST(g.i AS BIGINT) AS epoch_idx
  FROM (SELECT DISTINCT user_id AS subject FROM events) u, range({HOURS}) g(i)),
filled AS (
  SELECT g.subject, g.epoch_idx,
    CAST(coalesce(c1, 0) // 100 AS BIGINT) AS axis1, CAST(coalesce(c2, 0) // 100 AS BIGINT) AS axis2,
    CAST(coalesce(c3, 0) // 100 AS BIGINT) AS axis3, CAST(coalesce(n, 0) AS BIGINT) AS steps,
    CAST(coalesce(cb, 0) // 100 AS BIGINT) AS b_counts, CAST(coalesce(ch, 0) // 100 AS BIGINT) AS h_counts,
    coalesce(nb, 0) AS nb
  FROM grid g LEFT JOIN hourly h ON g.subject = h.subject AND g.epoch_idx = h.epoch_idx),
epochs AS MATERIALIZED (
  SELECT subject, epoch_idx, axis1, axis2, axis3, steps, b_counts, h_counts,
    sqrt(CAST(axis1 * axis1 + axis2 * axis2 + axis3 * axis3 AS DOUBLE)) AS vmu,
    CAST(CASE WHEN sum(nb) OVER (PARTITION BY subject ORDER BY epoch_idx ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) = 0
         THEN 1 ELSE 0 END AS INTEGER) AS truth
  FROM filled)"""

SIGNAL_SQL = f"""
daily AS (
  SELECT l_suppkey AS subject, CAST(date_diff('day', DATE '{FIRST_DAY}', CAST(l_shipdate AS DATE)) AS BIGINT) AS idx,
    sum(CAST(l_quantity AS BIGINT)) AS q, sum(CAST(round(l_discount * 100) AS BIGINT)) AS d,
    sum(CAST(round(l_tax * 100) AS BIGINT)) AS t
  FROM lineitem GROUP BY 1, 2),
calendar AS (
  SELECT s.subject, CAST(g.i AS BIGINT) AS idx
  FROM (SELECT DISTINCT l_suppkey AS subject FROM lineitem) s, range({DAYS}) g(i)),
signal AS MATERIALIZED (
  SELECT c.subject, c.idx, CAST(coalesce(q, 0) AS DOUBLE) / 64 AS y, CAST(coalesce(d, 0) AS DOUBLE) / 16 AS x,
    CAST(coalesce(t, 0) AS DOUBLE) / 16 AS z
  FROM calendar c LEFT JOIN daily l ON c.subject = l.subject AND c.idx = l.idx)"""


class Tables:
    """Lazily built canonical tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        # The given timestamps carry no zone; hours of the day are those of UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.rows = 0
        plan_by_measure(spark, 0)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _subjects(self, table: str, key: str) -> DataFrame:
        return self.raw(table).select(F.col(key).alias("subject")).distinct()

    def _plan(self, subjects: DataFrame, length: int) -> None:
        """Partitions for a calendar of ``length`` rows a subject; queries with both calendars need those of the longer."""
        self.rows = max(self.rows, subjects.count() * length)
        plan_by_measure(self.spark, self.rows)

    def placed(self, *names: str) -> list[DataFrame]:
        """``epochs``, ``signal`` or both, with the rows of a subject, which their calendars bound, in one task.

        What works by subject reads them without a shuffle of rows: only the packed calendars travel, once.
        """
        made = {"epochs": (self._epochs, ("events", "user_id"), HOURS), "signal": (self._signal, ("lineitem", "l_suppkey"), DAYS)}
        for name in names:
            self._plan(self._subjects(*made[name][1]), made[name][2])
        parts = max(self.spark.sparkContext.defaultParallelism, -(-self.rows // ROWS_PER_TASK))
        return [made[name][0](parts) for name in names]

    def _calendar(self, folded: DataFrame, subjects: DataFrame, idx: str, length: int, step: int,
                  values: tuple[str, ...], parts: int | None) -> DataFrame:
        """Zero-filled rows ``0 .. length-1`` per subject.

        Present rows travel as one small map per (subject, stretch of
        ``step`` positions); the zeros are only made after the shuffle.
        """
        stretch = F.call_function("div", F.col(idx), F.lit(step))
        entry = F.struct(F.col(idx), F.struct(*values).alias("v"))
        every = subjects.select("subject", F.explode(
            F.sequence(F.lit(0).cast("long"), F.lit(length // step - 1).cast("long"))).alias("_s"))
        none = F.lit(None).cast(f"struct<{idx}:bigint,v:struct<{','.join(f'{v}:bigint' for v in values)}>>")
        entries = folded.select("subject", stretch.alias("_s"), entry.alias("_e")).unionByName(
            every.select("subject", "_s", none.alias("_e")))
        if parts:
            entries = entries.repartition(parts, "subject")
        packed = entries.groupBy("subject", "_s").agg(F.map_from_entries(F.collect_list("_e")).alias("_m"))
        positions = F.sequence(F.col("_s") * step, (F.col("_s") + 1) * step - 1)
        rows = packed.select("subject", "_m", F.explode(positions).alias(idx)).select(
            "subject", idx, F.try_element_at("_m", F.col(idx)).alias("_v"))
        return rows.select("subject", idx, *[F.coalesce(F.col(f"_v.{v}"), F.lit(0)).alias(v) for v in values])

    @cached_property
    def epochs(self) -> DataFrame:
        self._plan(self._subjects("events", "user_id"), HOURS)
        return self._epochs()

    def _epochs(self, parts: int | None = None) -> DataFrame:
        ev = self.raw("events")
        cents = F.round(F.col("value") * 100).cast("long")
        kind = F.col("event_type")
        seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
        zero = F.lit(0).cast("long")
        part = lambda *kinds: F.sum(F.when(kind.isin(*kinds), cents).otherwise(zero))
        folded = ev.groupBy(
            F.col("user_id").alias("subject"), F.floor((seconds - MONTH_START_SEC) / 3600).alias("epoch_idx"),
        ).agg(part("click", "view").alias("c1"), part("purchase").alias("c2"), part("view").alias("c3"),
              part("error").alias("cb"), part("signup").alias("ch"),
              F.sum(F.when(kind.isin("error", "signup"), F.lit(1)).otherwise(F.lit(0))).alias("nb"),
              F.count(F.lit(1)).alias("n"))
        filled = self._calendar(folded, self._subjects("events", "user_id"), "epoch_idx", HOURS, 120,
                                ("c1", "c2", "c3", "cb", "ch", "nb", "n"), parts)
        whole = lambda c: F.call_function("div", F.col(c), F.lit(100))
        # The calendar bounds this window: 720 rows per subject.
        around = W.partitionBy("subject").orderBy("epoch_idx").rowsBetween(-8, 8)
        out = filled.select(
            "subject", "epoch_idx", whole("c1").alias("axis1"), whole("c2").alias("axis2"), whole("c3").alias("axis3"),
            F.col("n").alias("steps"), whole("cb").alias("b_counts"), whole("ch").alias("h_counts"),
            F.when(F.sum("nb").over(around) == 0, 1).otherwise(0).alias("truth"))
        vm2 = F.col("axis1") * F.col("axis1") + F.col("axis2") * F.col("axis2") + F.col("axis3") * F.col("axis3")
        return out.select("*", F.sqrt(vm2.cast("double")).alias("vmu"),
                          F.timestamp_seconds(F.col("epoch_idx") * 3600 + MONTH_START_SEC).alias("ts"))

    @cached_property
    def signal(self) -> DataFrame:
        self._plan(self._subjects("lineitem", "l_suppkey"), DAYS)
        return self._signal()

    def _signal(self, parts: int | None = None) -> DataFrame:
        li = self.raw("lineitem")
        folded = li.groupBy(
            F.col("l_suppkey").alias("subject"),
            F.date_diff(F.to_date("l_shipdate"), F.lit(FIRST_DAY).cast("date")).cast("long").alias("idx"),
        ).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"),
              F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("d"),
              F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("t"))
        filled = self._calendar(folded, self._subjects("lineitem", "l_suppkey"), "idx", DAYS, 100, ("q", "d", "t"), parts)
        return filled.select(
            "subject", "idx", (F.col("q") / 64).alias("y"), (F.col("d") / 16).alias("x"), (F.col("t") / 16).alias("z"))

    @cached_property
    def stored_signal(self) -> DataFrame:
        """``signal`` as a table, for queries that read it more than once."""
        return stash(self.signal)
