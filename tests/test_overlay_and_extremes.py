"""Label overlays and sliding extremes against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from stillwave.operators import overlay as O
from stillwave.operators.chunked import OWN, sliding_extremes, spread
from stillwave.plans import reports


def label_rows(seed, subjects, length, names, stay=0.8):
    rnd = random.Random(seed)
    rows = []
    for s in subjects:
        now = [rnd.randint(0, 1) for _ in names]
        for i in range(length[s]):
            now = [x if rnd.random() < stay else 1 - x for x in now]
            rows.append((s, i, *now))
    return rows


@pytest.mark.parametrize("size", [16, 1000])
def test_overlay_is_the_per_tick_table(spark, size):
    raw = label_rows(1, [1, 2, 3], {1: 230, 2: 500, 3: 41}, ["truth"])
    counts = label_rows(2, [1, 2, 4], {1: 40, 2: 70, 4: 9}, ["a", "b"])
    blocks = label_rows(3, [1, 2, 3, 4], {1: 9, 2: 50, 3: 5, 4: 2}, ["c"], stay=0.3)
    make = lambda rows, names: spark.createDataFrame(rows, f"subject long, i long, {', '.join(f'{n} int' for n in names)}")
    ranges = O.overlay({
        "raw": O.scaled(O.change_points(make(raw, ["truth"]), ["truth"], "i", size=size), every=5),
        "counts": O.scaled(O.change_points(make(counts, ["a", "b"]), ["a", "b"], "i", size=size), repeat=2),
        "blocks": O.scaled(O.change_points(make(blocks, ["c"]), ["c"], "i", size=size), repeat=10)}, size=size)
    table = {}
    for rows, name, take in ((raw, "raw", lambda i: [i // 5] if i % 5 == 0 else []),
                             (counts, "counts", lambda i: [2 * i, 2 * i + 1]),
                             (blocks, "blocks", lambda i: range(10 * i, 10 * i + 10))):
        for s, i, *values in rows:
            for sec in take(i):
                table.setdefault((s, sec), {})[name] = values
    want = sorted((s, sec, *x["raw"], *x["counts"], *x["blocks"]) for (s, sec), x in table.items() if len(x) == 3)
    got = [tuple(r) for r in O.per_tick(ranges).select("subject", "sec", "truth", "a", "b", "c").collect()]
    assert sorted(got) == want and {r[0] for r in want} == {1, 2}

    totals = reports.overlay_totals(ranges, ["a", "b", "c"], F.col("subject") * 25_150, first=25_160, last=50_310)
    found = {(r.variant, r.method): (r.tn, r.fp, r.fn, r.tp) for r in totals.collect()}
    for variant in ("all", "daytime"):
        for at, method in ((3, "a"), (4, "b"), (5, "c")):
            cells = [0, 0, 0, 0]
            for row in want:
                if variant == "all" or 25_160 <= (row[1] + row[0] * 25_150) % 86_400 <= 50_310:
                    cells[2 * row[2] + row[at]] += 1
            assert found[variant, method] == tuple(cells)


def test_overlay_of_nothing(spark):
    empty = spark.createDataFrame([], "subject long, idx long, a int")
    other = spark.createDataFrame([(1, 0, 1)], "subject long, idx long, b int")
    sets = {"x": O.change_points(empty, ["a"]), "y": O.change_points(other, ["b"])}
    assert O.overlay(sets).collect() == []


def test_ticks_of_day(spark):
    rnd = random.Random(6)
    spans = [(a := rnd.randint(0, 300), a + rnd.randint(0, 300)) for _ in range(60)]
    df = spark.createDataFrame(spans, "a long, b long")
    got = df.select("a", "b", O.ticks_of_day(F.col("a"), F.col("b"), 20, 60, 100).alias("n")).collect()
    assert all(r.n == sum(20 <= x % 100 <= 60 for x in range(r.a, r.b)) for r in got)


@pytest.mark.parametrize("before, after, size", [(0, 0, 8), (0, 4, 8), (5, 4, 16), (7, 0, 1000), (0, 134, 64), (30, 30, 20)])
def test_sliding_extremes(spark, before, after, size):
    rnd = random.Random(before + after)
    rows = [(s, i, rnd.choice([None, *range(50)])) for s, n in ((1, 100), (2, 3), (3, 1)) for i in range(n)]
    df = spread(spark.createDataFrame(rows, "subject long, idx long, v long"), ("subject",), "idx", size, before, after)
    ends = sliding_extremes(df, ("subject",), "idx", before, after, {"low": ("min", "v"), "high": ("max", "v")}).filter(OWN)
    values = {(s, i): v for s, i, v in rows}
    for r in ends.collect():
        near = [v for j in range(r.idx - before, r.idx + after + 1) if (v := values.get((r.subject, j))) is not None]
        assert (r.low, r.high) == ((min(near), max(near)) if near else (None, None)), (r, near)
    assert ends.count() == len(rows)
