import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loops import choi_loop, hecht_loop, hees_loop, troiano_loop
from stillwave.operators import detectors as D


def random_series(rng, n_subjects, max_len, high):
    """Zero-heavy series with quiet stretches and spikes of three sizes."""
    out = {}
    for s in range(n_subjects):
        n = int(rng.integers(1, max_len))
        v = np.where(rng.random(n) < rng.choice([0.1, 0.4, 0.8]), rng.integers(0, high, n), 0)
        out[f"s{s:03d}"] = v
    return out


def frame(spark, series):
    pdf = pd.concat([pd.DataFrame({"subject": k, "epoch_idx": np.arange(len(v)), "v": v.astype(float)})
                     for k, v in series.items()])
    return spark.createDataFrame(pdf)


def compare(df, series, loop):
    got = df.select("subject", "epoch_idx", "wear").toPandas().sort_values(["subject", "epoch_idx"])
    quiet = 0
    for key, part in got.groupby("subject"):
        want = loop(series[key])
        assert part.wear.tolist() == want.tolist(), (key, series[key].tolist())
        quiet += (want == 0).any()
    assert len(got) == sum(map(len, series.values()))
    return quiet


@pytest.mark.parametrize("size", [5, 1000])
@pytest.mark.parametrize("params", [(5, 4, 2), (0, 1, 1), (3, 9, 3)])
def test_hecht(spark, size, params):
    t, w, m = params
    series = random_series(np.random.default_rng(1), 40, 60, 12)
    out = D.hecht(frame(spark, series), F.col("v"), 60, t, w, m, size=size)
    assert compare(out, series, lambda v: hecht_loop(v, t, w, m)) > 5


def test_hecht_edges_and_bad_interval(spark):
    series = {"a": np.zeros(30, int)}
    out = D.hecht(frame(spark, series), F.col("v"), size=7)
    assert out.filter("wear = 0").count() == 30
    with pytest.raises(ValueError):
        D.hecht(frame(spark, series), F.col("v"), epoch_sec=37)


@pytest.mark.parametrize("size", [4, 1000])
@pytest.mark.parametrize("params", [(0, 3, 2, 10), (0, 5, 0, 4), (2, 4, 1, 6), (6, 3, 2, 2), (0, 1, 3, 11)])
def test_troiano(spark, size, params):
    at, mpl, tol, ss = params
    series = random_series(np.random.default_rng(2), 50, 60, 12)
    out = D.troiano(frame(spark, series), F.col("v"), at, mpl, tol, ss, size=size)
    assert compare(out, series, lambda v: troiano_loop(v, at, mpl, tol, ss)) > 5


def test_troiano_literal_cases(spark):
    series = {
        "kept": np.array([0, 0, 0, 10, 0, 0, 10, 10, 0, 0, 0, 10, 10, 0, 0, 0]),
        "broken": np.array([0, 0, 0, 10, 10, 10]),
        "short": np.array([0, 0]),
    }
    out = D.troiano(frame(spark, series), F.col("v"), 0, 5, 2, 100, size=4).toPandas()
    wear = {k: p.sort_values("epoch_idx").wear.tolist() for k, p in out.groupby("subject")}
    assert wear["kept"] == [0] * 15 + [1]
    assert wear["broken"] == [0] * 5 + [1]
    assert wear["short"] == [1, 1]


@pytest.mark.parametrize("size", [4, 1000])
@pytest.mark.parametrize("params", [(0, 3, 2, 4, 1), (0, 2, 0, 6, 2), (2, 3, 1, 3, 0), (3, 2, 3, 5, 3), (0, 4, 4, 8, 4)])
def test_choi(spark, size, params):
    at, mpl, tol, mwl, wst = params
    series = random_series(np.random.default_rng(3), 60, 60, 8)
    out = D.choi(frame(spark, series), F.col("v"), at, mpl, tol, mwl, wst, size=size)
    assert compare(out, series, lambda v: choi_loop(v, at, mpl, tol, mwl, wst)) > 3


def test_choi_open_tail_is_wear(spark):
    series = {"a": np.zeros(200, int)}
    assert D.choi(frame(spark, series), F.col("v"), size=16).filter("wear = 0").count() == 0


@pytest.mark.parametrize("size", [3, 1000])
@pytest.mark.parametrize("window,step", [(4, 1), (4, 2), (3, 2), (2, 2)])
def test_hees(spark, size, window, step):
    rng = np.random.default_rng(4)
    per_min = 6
    data, parts = {}, []
    for s in range(20):
        n = int(rng.integers(10, 200))
        scale = np.repeat(rng.choice([0.001, 0.2], size=n // 12 + 1), 12)[:n]
        data[f"s{s}"] = rng.normal(0, 1, (n, 3)) * scale[:, None]
        parts.append(pd.DataFrame(data[f"s{s}"], columns=["y", "x", "z"]).assign(subject=f"s{s}", idx=np.arange(n)))
    signal = spark.createDataFrame(pd.concat(parts))
    from math import gcd
    unit = gcd(step, window) * per_min
    blocks = D.hees(signal, window_mins=window, step_mins=step, std_mg=3, range_mg=8, size=size, samples_per_min=per_min)
    got = D.expand_blocks(signal, blocks, unit).toPandas().sort_values(["subject", "idx"])
    quiet = 0
    for key, part in got.groupby("subject"):
        want = hees_loop(data[key], window * per_min, step * per_min, 0.003, 2, 0.008, 2)
        assert part.wear.tolist() == want.tolist(), key
        quiet += (want == 0).any()
    assert quiet > 3


def test_a_large_subject_is_spread_over_tasks(spark):
    """Rows hashed by subject alone are moved by (subject, chunk) before any window."""
    n = 40_000
    name = F.substring(F.concat(F.lit("a"), F.col("id").cast("string")), 1, 1)
    df = spark.range(n).select(name.alias("subject"), F.col("id").alias("epoch_idx"), (F.col("id") % 97 == 0).cast("double").alias("v"))
    out = D.troiano(df.repartition(4, "subject"), F.col("v"), 0, 30, 2, 100, size=1000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(subject#\d+, _chunk#\d+", plan)
    want = troiano_loop(np.array([float(i % 97 == 0) for i in range(n)]), 0, 30, 2, 100)
    assert out.filter("wear = 0").count() == int((want == 0).sum())
