import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loops import keogh_loop
from stillwave.functions.expressions import WEIGHTS
from stillwave.operators import calibration as C, features as X, filtering as R, statistics as ST


def recursion(sections, x):
    """Sample-by-sample cascade started at rest at the first value."""
    y = x.astype(float)
    for b0, b1, b2, a1, a2 in sections:
        steady = (b0 + b1 + b2) / (1 + a1 + a2)
        s2 = (b2 - a2 * steady) * y[0]
        s1 = (b1 - a1 * steady) * y[0] + s2
        out = np.empty_like(y)
        for i, v in enumerate(y):
            out[i] = b0 * v + s1
            s1, s2 = b1 * v - a1 * out[i] + s2, b2 * v - a2 * out[i]
        y = out
    return y


def frame(spark, data):
    return spark.createDataFrame(pd.concat([
        pd.DataFrame(v, columns=["y", "x", "z"]).assign(subject=k, idx=np.arange(len(v))) for k, v in data.items()]))


def test_bandpass_equals_recursion_over_the_whole_signal(spark):
    rng = np.random.default_rng(0)
    data = {"a": rng.normal(0, 1, (900, 3)) + 2, "b": np.cumsum(rng.normal(0, .1, (333, 3)), axis=0)}
    out = R.butterworth_bandpass(frame(spark, data), 0.5, 2.0, 10, chunk_rows=100).toPandas()
    sections = R.butterworth_sections(4, 0.5, 2.0, 10)
    pad = 27
    for key, part in out.groupby("subject"):
        part = part.sort_values("idx")
        assert part.idx.tolist() == list(range(len(data[key])))
        for j, axis in enumerate("yxz"):
            x = data[key][:, j]
            ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2:-pad - 2:-1]])
            want = recursion(sections, recursion(sections, ext)[::-1])[::-1][pad:-pad]
            assert np.abs(part[axis].to_numpy() - want).max() < 1e-6


def test_bandpass_gain():
    s = R.butterworth_sections(4, 0.01, 7, 32)
    for f, want in ((0.01, 2 ** -.5), (7.0, 2 ** -.5), (0.26, 1.0), (1e-4, 0.0), (15.9, 0.0)):
        w = np.exp(-2j * np.pi * f / 32)
        h = np.prod([(b0 + w * (b1 + w * b2)) / (1 + w * (a1 + w * a2)) for b0, b1, b2, a1, a2 in s])
        assert abs(abs(h) - want) < 1e-2


@pytest.mark.parametrize("rates", [(100, 32), (10, 25)])
def test_resample_keeps_a_slow_wave(spark, rates):
    a, b = rates
    n = a * 20 + 3
    t = np.arange(n) / a
    data = {"s": np.stack([np.sin(2 * np.pi * t), np.cos(2 * np.pi * .7 * t), 0 * t + 1], axis=1)}
    whole = R.resample(frame(spark, data), a, b, chunk_secs=1000).toPandas().sort_values("idx")
    parts = R.resample(frame(spark, data), a, b, chunk_secs=3).toPandas().sort_values("idx")
    assert len(whole) == n // a * b and parts.idx.tolist() == list(range(len(whole)))
    assert np.abs(whole[["y", "x", "z"]].to_numpy() - parts[["y", "x", "z"]].to_numpy()).max() < 1e-9
    mid = slice(5 * b, 15 * b)
    want = np.sin(2 * np.pi * np.arange(len(whole)) / b)
    assert np.abs(whole["y"].to_numpy()[mid] - want[mid]).max() < 1e-2


def test_calibration_recovers_weights(spark):
    rng = np.random.default_rng(1)
    truth = {"a": ([1.05, .96, 1.02], [.03, -.04, .02]), "b": ([.9, 1.1, 1.0], [0., .05, -.05])}
    rows = []
    for key, (t, b) in truth.items():
        u = rng.normal(size=(300, 3)); u /= np.linalg.norm(u, axis=1)[:, None]
        rows += [(key, *p) for p in ((u - b) / t).tolist()]
    rows += [("c", .1, .1, .1)] * 5
    points = spark.createDataFrame(rows, "subject string, y double, x double, z double")
    got = {r.subject: r for r in C.calibration_weights(points).collect()}
    for key, (t, b) in truth.items():
        assert np.allclose([got[key][w] for w in WEIGHTS], [*t, *b], atol=1e-5)
    assert [got["c"][w] for w in WEIGHTS] == [1, 1, 1, 0, 0, 0] and not got["c"].fit


def test_features_against_numpy(spark):
    rng = np.random.default_rng(2)
    data = {("s", c): np.round(rng.normal(0, 2, (int(rng.integers(2, 60)), 3)) * 4) / 4 for c in range(6)}
    pdf = pd.concat([pd.DataFrame(v, columns=list("abc")).assign(subject=k[0], counter=k[1], idx=np.arange(len(v)) * 3 + 7)
                     for k, v in data.items()])
    for size in (5, 65_536):
        out = X.segment_features(spark.createDataFrame(pdf), size=size, cell=0.5).collect()
        assert len(out) == len(data)
        for r in out:
            v = data[(r.subject, r.counter)]
            a, b = v[:, 0], v[:, 1]
            mode = lambda z: min(zip(*np.unique(z, return_counts=True)), key=lambda p: (-p[1], p[0]))[0]
            assert np.isclose(r.a_std, a.std()) and np.isclose(r.b_median, np.median(b)) and np.isclose(r.a_mode, mode(a))
            assert np.isclose(r.ab_diff_ptp, np.ptp(b) - np.ptp(a)) and np.isclose(r.ab_diff_mode, mode(b) - mode(a))
            if a.std() > 0:
                assert np.isclose(r.a_kur, ((a - a.mean()) ** 4).mean() / a.var() ** 2 - 3)
                assert np.isclose(r.a_signal_to_noise, a.mean() / a.std())
            assert np.isclose(r.ab_dtw_1, keogh_loop(b, a, 1))


def test_p_values(spark):
    one = spark.range(1)
    got = one.select(
        ST.t_two_sided(F.lit(2.0), F.lit(10.0)).alias("t"), ST.f_tail(F.lit(3.0), F.lit(2.0), F.lit(12.0)).alias("f"),
        ST.t_two_sided(F.lit(0.0), F.lit(5.0)).alias("zero"), ST.t_two_sided(F.lit(1.0), F.lit(1.0)).alias("cauchy")).first()
    assert abs(got.t - 0.0733880348) < 1e-9
    assert abs(got.f - (1 + 3.0 * 2 / 12) ** -6) < 1e-9  # closed form for two numerator degrees
    assert got.zero == pytest.approx(1.0) and got.cauchy == pytest.approx(0.5)
