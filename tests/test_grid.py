from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loops import choi_loop, hecht_loop, hees_loop, troiano_loop
from stillwave.operators.blocks import block_stats
from stillwave.plans import grid as G
from stillwave.functions import fixed_values as FV


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(21)
    out = {}
    for s in range(8):
        n = int(rng.integers(12, 80))
        v = np.where(rng.random(n) < rng.choice([0.15, 0.4]), rng.integers(0, 12, n), 0)
        w = v + np.where(rng.random(n) < 0.1, 3, 0)
        out[f"s{s}"] = (v, w, rng.integers(0, 2, n))
    return out


@pytest.fixture(scope="module")
def epochs(spark, series):
    return spark.createDataFrame(pd.concat([
        pd.DataFrame({"subject": k, "epoch_idx": np.arange(len(v)), "axis1": v.astype(float), "vmu": w.astype(float), "truth": t})
        for k, (v, w, t) in series.items()])).cache()


def check(conf, names, series, space, loop):
    rows = conf.collect()
    assert len(rows) == len(series) * np.prod([len(x) for x in space.values()])
    seen = 0
    for r in rows:
        v, w, t = series[r.subject]
        pred = 1 - loop(v, w, {n: r[n] for n in names})
        want = tuple(int(((t == a) & (pred == b)).sum()) for a, b in [(0, 0), (0, 1), (1, 0), (1, 1)])
        assert (r.tn, r.fp, r.fn, r.tp) == want, r
        seen += r.tp > 0
    assert seen > 20


@pytest.mark.parametrize("size", [6, 1000])
def test_hecht_grid(spark, epochs, series, size):
    space = {"t": [0, 3, 6], "i": [2, 5], "m": [1, 2, 4]}
    check(G.hecht_grid(epochs, space, size=size), list(space), series, space,
          lambda v, w, p: hecht_loop(w, p["t"], p["i"], p["m"]))


@pytest.mark.parametrize("size", [6, 1000])
def test_troiano_grid(spark, epochs, series, size):
    space = {"at": [0, 4], "mpl": [1, 3, 8], "st": [0, 1, 3], "ss": [2, 6, 11], "vm": [True, False]}
    check(G.troiano_grid(epochs, space, size=size), list(space), series, space,
          lambda v, w, p: troiano_loop(w if p["vm"] else v, p["at"], p["mpl"], p["st"], p["ss"]))


@pytest.mark.parametrize("size", [6, 1000])
def test_choi_grid(spark, epochs, series, size):
    space = {"at": [0, 3], "mpl": [1, 4], "st": [0, 1, 2], "mwl": [3, 6], "wst": [0, 2], "vm": [True, False]}
    check(G.choi_grid(epochs, space, size=size), list(space), series, space,
          lambda v, w, p: choi_loop(w if p["vm"] else v, p["at"], p["mpl"], p["st"], p["mwl"], p["wst"]))


@pytest.mark.parametrize("size", [4, 1000])
def test_hees_grid(spark, size):
    rng = np.random.default_rng(8)
    unit, data, truth, parts = 4, {}, {}, []
    for s in range(6):
        n = int(rng.integers(20, 120))
        scale = np.repeat(rng.choice([0.001, 0.004, 0.2], size=n // 8 + 1), 8)[:n]
        data[f"s{s}"] = rng.normal(0, 1, (n, 3)) * scale[:, None]
        truth[f"s{s}"] = rng.integers(0, 2, n)
        parts.append(pd.DataFrame(data[f"s{s}"], columns=["y", "x", "z"]).assign(
            subject=f"s{s}", idx=np.arange(n), truth=truth[f"s{s}"]))
    signal = spark.createDataFrame(pd.concat(parts))
    space = {"mw": [2, 3], "wo": [1], "st": [1, 3, 5], "sa": [1, 2, 3], "vt": [2, 9], "va": [1, 3]}
    block_truth = signal.groupBy("subject", F.expr(f"idx div {unit}").alias("block")).agg(
        F.count("*").alias("n"), F.sum("truth").alias("truth"))
    conf = G.hees_grid(block_stats(signal, unit), block_truth, space, unit, size=size)
    rows = conf.collect()
    assert len(rows) == 6 * len(G.combinations(space))
    for r in rows:
        pred = 1 - hees_loop(data[r.subject], r.mw * unit, unit, r.st / 1000, r.sa, r.vt / 1000, r.va)
        t = truth[r.subject]
        assert (r.tn, r.fp, r.fn, r.tp) == tuple(
            int(((t == a) & (pred == b)).sum()) for a, b in [(0, 0), (0, 1), (1, 0), (1, 1)]), r


def test_space_sizes():
    sizes = [len(G.combinations(s)) for s in (
        FV.HECHT_SPACE, FV.TROIANO_SPACE, FV.CHOI_SPACE, FV.HEES_SPACE, FV.EDGE_DECISION_SPACE, FV.BASELINE_SPACE)]
    assert sizes == [1100, 9900, 10500, 5103, 20, 32]


@pytest.mark.parametrize("size", [6, 1000])
@pytest.mark.parametrize("grid, space", [
    ("hecht", {"t": [0, 3], "i": [2, 5], "m": [1, 2]}),
    ("troiano", {"at": [0, 4], "mpl": [1, 3], "st": [0, 3], "ss": [2, 11], "vm": [True, False]}),
    ("choi", {"at": [0, 3], "mpl": [1, 4], "st": [0, 2], "mwl": [3, 6], "wst": [0, 2], "vm": [True]})])
def test_counts_over_all_subjects_are_the_sum_of_theirs(spark, epochs, grid, space, size):
    # A row without a subject counts as one, but is never marked.
    more = epochs.unionByName(spark.createDataFrame([(None, 0, 0.0, 0.0, 1)], epochs.schema))
    run = getattr(G, f"{grid}_grid")
    counts = [F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")]
    each = run(more, space, size=size).groupBy(*space).agg(*counts).collect()
    whole = run(more, space, size=size, by=()).select(*space, "tn", "fp", "fn", "tp").collect()
    assert sorted(map(tuple, each)) == sorted(map(tuple, whole))
    assert len(whole) == np.prod([len(v) for v in space.values()])


def test_hecht_rows_are_not_multiplied_by_the_space(spark, epochs, series):
    """No row is made for a threshold or window: a chunk leaves one row, and the space only comes after it."""
    space = {"t": [0, 3, 6], "i": [2, 5], "m": [4, 1, 2]}
    for by in (None, ()):
        plan = G.hecht_grid(epochs, space, by=by)._jdf.queryExecution().optimizedPlan().toString().split("\n")
        chunks = next(n for n, line in enumerate(plan) if "FlatMapGroupsInArrow" in line)
        assert not [line for line in plan[chunks + 1:] if "Generate" in line and "_chunk" not in line], plan
    # A missing count is quiet, one that is no number is not; rows without an index are counted and never marked.
    v = [0.0, None, float("nan"), 0.0, 9.0, 0.0, 0.0]
    odd = spark.createDataFrame([("a", i, 0.0, x, 1) for i, x in enumerate(v)] + [("a", None, 0.0, 0.0, 1), ("b", None, 0.0, 0.0, 0)],
                                "subject string, epoch_idx int, axis1 double, vmu double, truth int")
    got = {(r.subject, r.m): (r.tn, r.fp, r.fn, r.tp) for r in G.hecht_grid(odd, {"t": [3], "i": [2], "m": [1, 2]}, size=4).collect()}
    w = np.array([0, 0, 9, 0, 9, 0, 0])
    for m in (1, 2):
        marked = int((1 - hecht_loop(w, 3, 2, m)).sum())
        assert got["a", m] == (0, 0, 8 - marked, marked) and got["b", m] == (1, 0, 0, 0)


def test_hees_blocks_are_not_multiplied_by_the_space(spark):
    """A chunk of blocks leaves one row; blocks without truth count in windows but not in the totals."""
    unit, space = 2, {"mw": [2, 3, 5], "wo": [1], "st": [5, 1], "sa": [3, 1], "vt": [9, 2], "va": [2]}
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, (41, 3)) * np.repeat(rng.choice([0.0005, 0.003, 0.2], 11), 4)[:41, None]
    signal = spark.createDataFrame(pd.DataFrame(v, columns=["y", "x", "z"]).assign(subject="a", idx=np.arange(41)))
    blocks = block_stats(signal, unit)
    truth = blocks.filter("block % 4 <> 1").select("subject", "block", "n", F.when(F.col("block") % 3 == 0, F.col("n")).otherwise(0).alias("truth"))
    held = blocks.join(truth.select("block", "truth"), "block").filter("block % 4 <> 1")
    same = lambda *a, **b: sorted(map(tuple, G.hees_grid(*a, space, unit, **b).collect()))
    assert same(held, None, size=4) == same(held.drop("truth"), truth, size=None)
    for size in (4, None):
        conf = G.hees_grid(blocks, truth, space, unit, size=size)
        plan = conf._jdf.queryExecution().optimizedPlan().toString().split("\n")
        chunks = next(n for n, line in enumerate(plan) if "FlatMapGroupsInArrow" in line)
        assert not [line for line in plan[chunks + 1:] if "Generate" in line and "_chunk" not in line], plan
        rows = conf.collect()
        assert len(rows) == len(G.combinations(space))
        at = np.arange(41) // unit
        known, y = at % 4 != 1, (at % 3 == 0).astype(int)
        for r in rows:
            pred = 1 - hees_loop(v, r.mw * unit, unit, r.st / 1000, r.sa, r.vt / 1000, r.va)
            assert (r.tn, r.fp, r.fn, r.tp) == tuple(
                int((known & (y == a) & (pred == b)).sum()) for a, b in [(0, 0), (0, 1), (1, 0), (1, 1)]), r
