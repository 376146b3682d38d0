import pandas as pd
from pyspark.sql import functions as F

from checks.tables import HOURS, Tables
from stillwave.operators import align as A, detectors as D
from stillwave.session import spread_keys


def events(path, users):
    pd.DataFrame({"event_id": range(users), "ts": pd.Timestamp("2024-01-03 05:00:00"), "user_id": range(users),
                  "event_type": "click", "value": 3.5, "props": ""}).to_parquet(
        f"{path}/events.parquet", index=False, coerce_timestamps="us", allow_truncated_timestamps=True)


def test_many_epochs_of_few_events_are_not_broadcast(spark, tmp_path):
    """A few kilobytes of events give 144,000 epochs: their size is only known when they have been made."""
    events(tmp_path, 200)
    t = Tables(spark, str(tmp_path))
    nw = t.epochs.select("subject", "epoch_idx", F.col("truth").alias("nw"))
    joined = A.label_matrix(nw, {"a": nw.filter("epoch_idx >= 0"), "b": nw.filter("epoch_idx >= -1")}, on=("subject", "epoch_idx"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan, plan
    assert joined.count() == 200 * HOURS


def test_partitions_follow_the_rows_of_the_calendar(spark, tmp_path):
    events(tmp_path, 4200)  # 3,024,000 epochs
    t = Tables(spark, str(tmp_path))
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert int(spark.conf.get(name)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert t.epochs.columns
    assert int(spark.conf.get(name)) == 7


def test_few_keys_are_dealt_to_many_tasks(spark):
    dealt = spread_keys(spark.range(3000).withColumnRenamed("id", "subject"), ["subject"], rows=100)
    made = A.with_parameters(dealt, {"a": list(range(5)), "b": list(range(4))}).groupBy("subject", "a", "b").agg(
        F.count(F.lit(1)).alias("times"))
    assert dealt.rdd.getNumPartitions() == 30
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan  # that of the subjects, before the combinations are made
    assert made.filter("times = 1").count() == 3000 * 20


def test_rows_placed_by_subject_are_not_shuffled(spark, tmp_path):
    """Only the packed calendars travel: neither the detectors nor the timeline move a row of a calendar."""
    from checks import QUERIES

    events(tmp_path, 30)
    pd.DataFrame({"l_suppkey": [1, 1, 2, None], "l_quantity": [3.0, 64.0, 1.0, 2.0], "l_discount": 0.25, "l_tax": 0.5,
                  "l_shipdate": pd.to_datetime(["1995-03-04", "1996-03-04", "1995-01-02", "1995-01-03"])}).astype(
        {"l_suppkey": "Int64"}).to_parquet(f"{tmp_path}/lineitem.parquet", index=False, coerce_timestamps="us", allow_truncated_timestamps=True)
    for name in ("q10_timeline_with_raw_and_hees", "v2_label_matrix"):
        df = QUERIES[name](spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
        moved = [n for n, line in enumerate(plan) if "Exchange" in line]
        made = [n for n, line in enumerate(plan) if "sequence((_s" in line or "sequence(_s" in line or "explode(sequence" in line]
        assert moved and made and not [n for n in moved if n < made[0]], "\n".join(plan)
        assert df.count() == {"v2_label_matrix": 30 * HOURS, "q10_timeline_with_raw_and_hees": 2 * 2720 + 2500 + 28 * HOURS}[name]


def test_periods_are_the_same_where_a_key_is_one_chunk(spark):
    rnd = __import__("random").Random(4)
    rows = [(s, i, float(rnd.choice([0, 0, 0, 3, 30]))) for s in (1, 2, None) for i in range(90)]
    df = spark.createDataFrame(rows, "subject long, epoch_idx long, v double")
    for find in (lambda size: D.hecht(df, F.col("v"), 60, 5, 6, 1, size=size),
                 lambda size: D.troiano(df, F.col("v"), 0, 4, 1, 20, size=size),
                 lambda size: D.choi(df, F.col("v"), 0, 4, 2, 6, 1, size=size)):
        each = [{(r.subject, r.epoch_idx): r.wear for r in find(size).collect()} for size in (16, 1000, None)]
        known = [{k: x for k, x in found.items() if k[0] is not None} for found in each]
        assert known[0] == known[2] and len(known[0]) == 180 and {0, 1} == set(known[0].values())
        assert each[1] == each[2] and len(each[1]) == 270
