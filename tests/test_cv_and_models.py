import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stillwave.functions.metrics import metric_columns, with_interval_text, with_metrics
from stillwave.operators import align as A, epochs as P
from stillwave.operators.chunked import div, row_index, running_total
from stillwave.plans import cv, detection, grid as G, models, reports


def test_metrics_example(spark):
    df = spark.createDataFrame([(8, 2, 1, 4), (0, 0, 0, 0)], "tn long, fp long, fn long, tp long")
    a, b = with_metrics(df).collect()
    assert (a.accuracy, a.precision, a.specificity, a.recall) == (12 / 15, 4 / 6, 8 / 10, 4 / 5)
    assert a.f1 == pytest.approx(8 / 11) and a.npv == 8 / 9 and a.ppv == a.precision
    assert all(b[m] is None for m in ("accuracy", "precision", "f1", "npv"))
    assert spark.range(1).select(with_interval_text(F.lit(0.8), 583)).first()[0] == "0.800 ± 0.032"


def test_row_index_and_running_total(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 300), "v": rng.permutation(300), "w": rng.integers(0, 5, 300)})
    df = spark.createDataFrame(pdf)
    got = running_total(row_index(df, ["k"], ["v"], div("v", 7), "pos"), ["k"], ["v"], div("v", 11), {"upto": F.col("w")}).toPandas()
    for _, part in got.sort_values("v").groupby("k"):
        assert part.pos.tolist() == list(range(len(part))) and part.upto.tolist() == part.w.cumsum().tolist()
    globally = row_index(df, [], ["v"], div("v", 13), "pos").toPandas().sort_values("v")
    assert globally.pos.tolist() == list(range(300))


def test_cross_validation_against_a_loop(spark):
    rng = np.random.default_rng(4)
    n, combos = 23, [(a, b) for a in range(3) for b in range(2)]
    cls = (rng.random(n) < 0.4).astype(int)
    conf = {(s, c): rng.integers(0, 20, 4) for s in range(n) for c in combos}
    table = spark.createDataFrame([(s, *c, *map(int, v)) for (s, c), v in conf.items()],
                                  "subject int, a int, b int, tn int, fp int, fn int, tp int")
    subjects = spark.createDataFrame([(s, int(c)) for s, c in enumerate(cls)], "subject int, cls int")
    out = cv.cross_validate(table, subjects, ["subject"], div("subject", 4), ("a", "b"), folds=3)
    cut = n - int(np.ceil(n * .3))
    fold = {}
    for c in (0, 1):
        for i, part in enumerate(np.array_split([s for s in range(cut) if cls[s] == c], 3)):
            fold |= {int(s): i for s in part}
    f1 = lambda v: 2 * v[3] / (2 * v[3] + v[1] + v[2])
    best = {}
    for i in range(3):
        score = {c: f1(sum(conf[s, c] for s in range(cut) if fold[s] != i)) for c in combos}
        top = min(combos, key=lambda c: (-score[c], c))
        best[i] = (top, f1(sum(conf[s, top] for s in range(cut) if fold[s] == i)))
    got = {r.fold: ((r.a, r.b), r.f1) for r in out["folds"].collect()}
    assert {i: g[0] for i, g in got.items()} == {i: b[0] for i, b in best.items()}
    assert all(got[i][1] == pytest.approx(best[i][1]) for i in best)
    pick = min(best, key=lambda i: (-best[i][1], i))
    held = out["test"].first()
    assert (held.a, held.b) == best[pick][0]
    assert held.f1 == pytest.approx(f1(sum(conf[s, best[pick][0]] for s in range(cut, n))))
    assert out["training"].first().f1 == pytest.approx(np.mean([b[1] for b in best.values()]))


def test_detect_all_crops_and_numbers(spark):
    rng = np.random.default_rng(1)
    rows = [(s, i, 1_000_000 + 10 * i, int(rng.random() < .02) * 50) for s in ("a", "b", "x") for i in range(6 * 400 + 3)]
    raw = spark.createDataFrame(rows, "subject string, epoch_idx long, sec long, axis1 int").select(
        "subject", "epoch_idx", F.timestamp_seconds("sec").alias("ts"), "axis1", *[F.lit(0).alias(c) for c in ("axis2", "axis3", "steps")])
    limits = spark.createDataFrame([("a", 1_000_600, 1_020_000), ("b", 0, 1_010_000)], "subject string, a long, b long").select(
        "subject", F.timestamp_seconds("a").alias("start"), F.timestamp_seconds("b").alias("stop"))
    invalid = spark.createDataFrame([("b",)], "subject string")
    out = detection.detect_all(raw, limits, invalid=invalid)
    got = out.orderBy("epoch_idx").collect()
    assert {r.subject for r in got} == {"a"} and got[0].epoch_idx == 0 and len(got) == 324
    assert set(out.columns) == {"subject", "epoch_idx", "ts", "hecht", "troiano", "choi"}
    with pytest.raises(ValueError):
        P.roll_up(raw, 7, 60)


def test_edge_windows_decision(spark):
    n = 60
    signal = spark.createDataFrame([("a", i, float(i >= 30), 0.0, 0.0) for i in range(n)], "subject string, idx long, y double, x double, z double")
    ep = spark.createDataFrame([("a", 0, 2, 10), ("a", 1, 20, 40), ("a", 2, 35, 58)], "subject string, counter int, start_index long, stop_index long")
    w = A.edge_windows(signal, ep, 4)
    assert sorted((r.counter, r.side) for r in w.collect()) == [(0, "stop"), (1, "start"), (1, "stop"), (2, "start")]
    train = w.withColumn("label", F.col("w")[0]["y"].cast("int"))
    model = models.fit_windows(train, 4, layers=(4,), epochs=200)
    decide = lambda op, d: {r.counter: r.nw for r in models.edge_decision(signal, ep, model, 4, op, d).collect()}
    assert decide("or", False) == {0: 0, 1: 1, 2: 1}
    assert decide("and", True) == {0: 0, 1: 0, 2: 1}
    assert decide("or", True) == {0: 1, 1: 1, 2: 1}
    with pytest.raises(ValueError):
        models.edge_decision(signal, ep, model, 4, "xor")


@pytest.mark.parametrize("name", ["logistic", "linear_svm", "decision_tree", "multinomial_nb", "bernoulli_nb", "mlp", "ada_boost"])
def test_classifiers_fit(spark, name):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 80)
    rows = spark.createDataFrame(pd.DataFrame({"label": y.astype(float), "u": (2 * y - 1) + rng.normal(0, .3, 80), "v": rng.normal(0, 1, 80)}))
    model = models.fit(rows, name, ["u", "v"], degree=2 if name == "logistic" else 1)
    assert models.misclassified(model, rows).count() < 25


def test_search_and_grid_errors(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 90)
    rows = spark.createDataFrame(pd.DataFrame({"subject": np.arange(90), "counter": 0, "label": y.astype(float), "u": y + rng.normal(0, .2, 90)}))
    found = models.search(rows, "decision_tree", ["u"], folds=2, values={"maxDepth": [1, 3]})
    assert found["metrics"].first().accuracy > 0.8
    with pytest.raises(ValueError):
        models.parameter_grid(models.pipeline("logistic", ["u"]), {"shrinking": [True]})
    with pytest.raises(ValueError):
        models.classifier("forest")
    assert models.number_range(0, 1, 3) == [0, .5, 1] and len(models.number_range(0, 1, 4, random=True)) == 4


def test_balance(spark):
    rows = spark.createDataFrame([(i, 0 if i < 7 else 1) for i in range(27)], "i int, label int")
    assert {r.label: r["count"] for r in models.balance(rows, "label", 42).groupBy("label").count().collect()} == {0: 14, 1: 20}


def test_best_ties_and_ranges(spark):
    df = spark.createDataFrame([("h", 1, 5, .5), ("h", 2, 5, .7), ("h", 3, 6, .7), ("t", 1, 1, .2)], "m string, a int, b int, f1 double")
    assert {(r.m, r.a) for r in G.best_row(df, "f1", ["m"], ["a"]).collect()} == {("h", 2), ("t", 1)}
    assert G.best_with_ties(df, "f1", ["m"]).count() == 3
    assert {(r.m, r.a, r.b) for r in G.tied_ranges(df, "f1", ["a", "b"], ["m"]).collect()} == {("h", "2--3", "5--6"), ("t", "1", "1")}


def test_history_tables(spark):
    h = spark.createDataFrame([("n1", 1, .5, .5, .4, .4), ("n1", 2, .8, .6, .0, .0)],
                              "net string, epoch int, precision double, recall double, val_precision double, val_recall double")
    last = reports.last_epoch(reports.history_f1(h), ["net"]).first()
    assert last.epoch == 2 and last.f1 == pytest.approx(.96 / 1.4) and last.val_f1 is None


def test_seed_search_adds_up_vectors(spark):
    rows = spark.range(300).selectExpr("id AS key", "int(id % 3) AS label").repartition(5)
    got = models.split_seed_search(rows, "key", "label", trials=1500, test_share=0.25).first()
    zero = rows.filter("label = 0")
    best = None
    for first in range(0, 1500, 500):
        sums = zero.agg(*[F.sum(models.hashed_split(zero, "key", seed, 0.25).cast("int")).alias(str(seed))
                          for seed in range(first, first + 500)]).first().asDict()
        best = max([x for x in [best, *((n, -int(seed)) for seed, n in sums.items())] if x is not None])
    assert (got.zeros_in_test, -got.seed) == best
    assert models.split_seed_search(rows.limit(0), "key", "label", trials=10).first().seed is None


def test_edge_grid_by_one_refinement_is_the_one_of_each_distance(spark):
    """Every distance merged, refined and classified by itself gives the same counts."""
    import numpy as np

    from stillwave.operators.align import edge_windows
    from stillwave.operators.episodes import group_near, overlap_confusion, to_episodes, union_intervals
    from stillwave.operators.segments import refine_edges

    rng = np.random.default_rng(4)
    signal = spark.createDataFrame(
        [(s, i, *(float(v) for v in rng.choice([0.0, 0.0, 0.5], 3))) for s in (1, 2, 3) for i in range(400)],
        "subject long, idx long, y double, x double, z double")
    spans = []
    for s in (1, 2, 3):
        cuts = sorted(rng.choice(np.arange(10, 390), 20, replace=False).tolist())
        spans += [(s, c, a, b) for c, (a, b) in enumerate(zip(cuts[::2], cuts[1::2]))]
    episodes = spark.createDataFrame(spans, "subject long, counter int, start_index long, stop_index long")
    truth = signal.selectExpr("subject", "idx", "int(y = 0) AS truth")
    windows = edge_windows(signal, episodes.withColumn("label", (F.col("start_index") % 2).cast("int")), 4)
    model = models.fit_windows(windows, 4, layers=(3,), epochs=5)
    space = {"edge": [True, False], "op": ["or", "and"], "distance": [1, 4]}
    got = {(r.edge, r.op, r.distance): (r.tn, r.fp, r.fn, r.tp) for r in models.edge_decision_grid(
        signal, episodes, truth, model, 4, space, hz=2, std_threshold=0.3, samples_per_min=5, max_steps=6).collect()}
    runs = to_episodes(truth, F.col("truth") == 1, ts=None, counter=False).selectExpr(
        "subject", "start_index AS start", "stop_index + 1 AS stop")
    n = truth.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    for distance in space["distance"]:
        grouped = refine_edges(signal, group_near(episodes, distance, 3, 2, samples_per_min=5), 0.3, 2, 6)
        for edge in space["edge"]:
            for op in space["op"]:
                chosen = models.edge_decision(signal, grouped, model, 4, op, edge).filter("nw = 1").selectExpr(
                    "subject", "start_index AS start", "stop_index AS stop")
                conf = overlap_confusion(union_intervals(chosen, ("subject",)), runs, n)
                want = conf.agg(*[F.sum(c) for c in ("tn", "fp", "fn", "tp")]).first()
                assert got[edge, op, distance] == tuple(want), (edge, op, distance)
