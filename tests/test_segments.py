import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loops import candidate_loop, edge_loop, runs_loop
from stillwave.operators import episodes as E, segments as S


def signals(seed, subjects=12, minute=6, hi=240):
    rng = np.random.default_rng(seed)
    data = {}
    for s in range(subjects):
        n = int(rng.integers(minute, hi))
        scale = np.repeat(rng.choice([0.0, 0.02, 0.06, 0.3], p=[.3, .3, .2, .2], size=n // minute + 1), minute)[:n]
        data[f"s{s:02d}"] = np.round(rng.normal(0, 1, (n, 3)) * scale[:, None] * 64) / 64
    return data


def frame(spark, data):
    return spark.createDataFrame(pd.concat([
        pd.DataFrame(v, columns=["y", "x", "z"]).assign(subject=k, idx=np.arange(len(v))) for k, v in data.items()]))


@pytest.mark.parametrize("window,use_vmu,min_len,size", [(1, False, 1, 3), (1, False, 2, 1000), (2, False, 1, 4), (1, True, 1, 5)])
def test_candidates_with_growth(spark, window, use_vmu, min_len, size):
    minute = 6
    data = signals(5 + window)
    # one subject whose last minute is one sample short
    data["s99"] = np.zeros((minute * 5 - 1, 3)); data["s99"][-3] = 0.05
    samples = frame(spark, data)
    thr = 0.055
    ranges = S.candidate_segments(samples, thr, min_length_mins=min_len, window_mins=window, use_vmu=use_vmu,
                                  samples_per_min=minute, size=size, look_ahead=2)
    got = E.mark_episodes(samples, ranges, block_rows=16).toPandas().sort_values(["subject", "idx"])
    found = grown = 0
    for key, part in got.groupby("subject"):
        want = candidate_loop(data[key], thr, minute, min_len, window, use_vmu)
        assert (1 - part.marked).tolist() == want.tolist(), key
        found += (want == 0).any()
        grown += (want == 0).sum()
    assert found > 5
    assert ranges.groupBy("subject").count().count() == found


def test_refine_edges(spark):
    hz = 3
    data = signals(11, subjects=10, minute=12, hi=300)
    samples = frame(spark, data)
    rng = np.random.default_rng(0)
    rows = [(k, c, int(a), int(b)) for k, v in data.items() for c in range(3)
            for a, b in [sorted(rng.integers(0, len(v), 2))]]
    episodes = spark.createDataFrame(rows, "subject string, counter int, start_index long, stop_index long")
    out = S.refine_edges(samples, episodes, 0.03, hz, max_steps=9, block_rows=4).collect()
    assert len(out) == len(rows)
    moved = 0
    before = {(r[0], r[1]): r[2:] for r in rows}
    for r in out:
        a, b = before[r.subject, r.counter]
        v = data[r.subject]
        assert r.start_index == edge_loop(v, a, hz, 0.03, 9, False)
        assert r.stop_index == edge_loop(v, b, hz, 0.03, 9, True)
        moved += (r.start_index, r.stop_index) != (a, b)
    assert moved > 5


def test_runs_example(spark):
    df = spark.createDataFrame([("a", i) for i in [1, 2, 3, 4, 8, 9, 10, 44]], "subject string, idx long")
    for size in (2, 3, 100):
        out = E.to_episodes(df, F.lit(True), ts=None, size=size).orderBy("counter").collect()
        assert [(r.start_index, r.stop_index, r.counter) for r in out] == [(1, 4, 0), (8, 10, 1), (44, 44, 2)]


@pytest.mark.parametrize("increment", [1, 3])
@pytest.mark.parametrize("size", [2, 7, 1000])
def test_runs_random(spark, size, increment):
    rng = np.random.default_rng(9)
    picks = {f"s{s}": np.sort(rng.choice(120, size=int(rng.integers(1, 90)), replace=False)) for s in range(15)}
    df = spark.createDataFrame([(k, int(i)) for k, v in picks.items() for i in v], "subject string, idx long")
    out = E.to_episodes(df, F.lit(True), ts=None, size=size, increment=increment).toPandas()
    for key, part in out.groupby("subject"):
        want = [(r[0], r[-1]) for r in runs_loop(picks[key], increment)]
        part = part.sort_values("counter")
        assert list(zip(part.start_index, part.stop_index)) == want
        assert part.counter.tolist() == list(range(len(want)))


def test_group_near_limit(spark):
    rows = [("a", 0, 0, 10, 1), ("a", 1, 10 + 6 * 3 + 3, 50, 0), ("a", 2, 50 + 6 * 3 + 4, 90, 1), ("b", 0, 5, 6, 0)]
    df = spark.createDataFrame(rows, "subject string, counter int, start_index long, stop_index long, label int")
    for size in (4, 1000):
        out = E.group_near(df, 3, 3, samples_per_min=6, size=size).orderBy("subject", "start_index").collect()
        assert [(r.subject, r.counter, r.start_index, r.stop_index, r.label) for r in out] == [
            ("a", "0-1", 0, 50, 1), ("a", "2", 72, 90, 1), ("b", "0", 5, 6, 0)]


def test_overlap_confusion_equals_counting(spark):
    rng = np.random.default_rng(3)
    vec = {f"s{s}": (rng.integers(0, 2, 90).repeat(3)[:200], rng.integers(0, 2, 90).repeat(4)[:200]) for s in range(6)}
    df = spark.createDataFrame([(k, i, int(a), int(b)) for k, (p, t) in vec.items() for i, (a, b) in enumerate(zip(p, t))],
                               "subject string, idx long, p int, t int")
    rng_of = lambda c: E.to_episodes(df, F.col(c) == 1, ts=None, counter=False).select(
        "subject", F.col("start_index").alias("start"), (F.col("stop_index") + 1).alias("stop"))
    totals = df.groupBy("subject").agg(F.count("*").alias("n"))
    out = E.overlap_confusion(rng_of("p"), rng_of("t"), totals, block_rows=7).collect()
    for r in out:
        p, t = vec[r.subject]
        assert (r.tn, r.fp, r.fn, r.tp) == tuple(int(((t == a) & (p == b)).sum()) for a, b in [(0, 0), (0, 1), (1, 0), (1, 1)])


@pytest.mark.parametrize("block,size", [(5, 9), (64, 1000)])
def test_union_of_any_intervals(spark, block, size):
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for s in range(12):
        hit = np.zeros(200, bool)
        for _ in range(int(rng.integers(1, 14))):
            a = int(rng.integers(0, 195)); b = min(a + int(rng.integers(0, 40)), 200)
            rows.append((f"s{s}", a, b)); hit[a:b] = True
        want[f"s{s}"] = [(r[0], r[-1] + 1) for r in runs_loop(np.where(hit)[0])]
    df = spark.createDataFrame(rows, "subject string, start long, stop long")
    got = E.union_intervals(df, block_rows=block, size=size).toPandas().sort_values("start")
    for key, w in want.items():
        part = got[got.subject == key]
        assert list(zip(part.start, part.stop)) == w


def test_several_growth_rounds(spark):
    """A long quiet stretch beside noisy minutes grows over many steps."""
    minute, n = 4, 4 * 120
    v = np.zeros((n, 3)); v[80 * minute::minute * 2] = 0.02
    data = {"a": v}
    ranges = S.candidate_segments(frame(spark, data), 0.006, samples_per_min=minute, look_ahead=1, size=7)
    got = E.mark_episodes(frame(spark, data), ranges).toPandas().sort_values("idx")
    want = candidate_loop(v, 0.006, minute)
    assert (1 - got.marked).tolist() == want.tolist()
    assert (want == 0).sum() > 80 * minute + 10


def test_growth_takes_one_round_and_stops_at_a_missing_minute(spark, monkeypatch):
    blocks = [b for b in range(400) if b != 150]
    minutes = spark.createDataFrame(
        [("a", b, 6, *[0.0] * 9) for b in blocks],
        "subject string, block long, n long, sum_y double, sum_x double, sum_z double, sumsq_y double, sumsq_x double, "
        "sumsq_z double, last_y double, last_x double, last_z double")
    islands = minutes.filter("block = 300").withColumnRenamed("block", "b0").selectExpr("*", "b0 AS b1", "n AS n_last")
    rounds = []
    kept = S.stash
    monkeypatch.setattr(S, "stash", lambda df: rounds.append(1) or kept(df))
    row = S.grow_islands(islands, minutes, 0.1, 6).collect()
    assert [(r.lo, r.b1, r.n) for r in row] == [(151, 399, 6 * 249)]
    assert len(rounds) == 1
    far = S.grow_islands(islands, minutes, 0.1, 6, look_ahead=2).collect()
    assert [(r.lo, r.b1, r.n) for r in far] == [(151, 399, 6 * 249)]


def test_quiet_runs_at_chunk_borders(spark):
    hz = 3
    data = signals(23, subjects=3, minute=6, hi=200)
    samples = frame(spark, data)
    rows = [(k, c, a, a + 40 + c) for k in data for c in range(3) for a in [c]]
    episodes = spark.createDataFrame(rows, "subject string, counter int, start_index long, stop_index long")
    seen = {tuple(r) for r in S.quiet_runs(samples, episodes, 0.03, hz, size=4).collect()}
    want = set()
    for k, v in data.items():
        for offset in range(hz):
            quiet = [s for s in range((len(v) - offset) // hz)
                     if (v[s * hz + offset:(s + 1) * hz + offset].std(axis=0) <= 0.03).all()]
            for s in quiet:
                if s - 1 not in quiet:
                    stop = s
                    while stop + 1 in quiet:
                        stop += 1
                    want.add((k, offset, s, stop))
    assert seen == want and want


def test_overlap_confusion_does_not_repeat_the_truth(spark):
    predicted = spark.createDataFrame([("a", 1, 0, 7), ("a", 2, 3, 12), ("b", 1, 2, 4)], "subject string, p int, start long, stop long")
    truth = spark.createDataFrame([("a", 5, 10), ("c", 0, 3)], "subject string, start long, stop long")
    totals = spark.createDataFrame([(s, p, 20) for s in "abc" for p in (1, 2)], "subject string, p int, n long")
    options = truth.withColumn("p", F.explode(F.array(F.lit(1), F.lit(2))))
    want = E.overlap_confusion(predicted, options, totals, 4, ("subject", "p")).collect()
    got = E.overlap_confusion(predicted, truth, totals, 4, ("subject", "p"), truth_keys=("subject",)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 6


def test_edges_that_go_on_are_tried_on_more_minutes_at_once():
    """A strided walk ends where steps of one minute end, and needs few strides for a long way."""
    import pyarrow as pa

    n, quiet = 700, np.ones(700, bool)
    quiet[[3, 650]] = False
    minutes = {"block": np.arange(n), "n": np.full(n, 5)}
    for a in S.AXES:
        minutes |= {f"sum_{a}": np.zeros(n), f"sumsq_{a}": np.where(quiet, 0.0, 50.0), f"last_{a}": np.zeros(n)}
    at = np.array([10, 300, 649])
    edges = {c: x[at] for c, x in minutes.items() if c != "block"} | {
        "b0": at, "b1": at, "lo": at, "_way": np.full(3, -1), "n_last": np.full(3, 5), "_chunk": np.zeros(3, int)}
    state, strides = [c for c in edges if c != "_chunk"], []
    walk, cumsum = S._walk(state, 0.1, 5, 1024), np.cumsum
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(S.np, "cumsum", lambda x, **k: strides.append(x.shape[1]) or cumsum(x, **k))
        out = walk(pa.table(edges), pa.table(minutes)).to_pydict()
    assert out["lo"] == [4, 4, 4] and out["b1"] == [649, 649, 649] and out["_way"] == [0, 0, 0]
    assert len(strides) < 40 * 7  # 160 and more strides of eight minutes, with seven sums each
