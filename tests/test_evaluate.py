import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.config import METRICS, model_order
from cohortlens.functions.student_t import quantile, two_sided_p
from cohortlens.operators import ensemble, evaluate

SCHEMA = "task string, model string, run int, row_id long, target int, prob double, pred int"


def preds(spark, runs, model="lr", task="ia", threshold=0.5):
    rows = [
        (task, model, run, i, t, float(p), int(p > threshold))
        for run, (targets, probs) in runs.items()
        for i, (t, p) in enumerate(zip(targets, probs))
    ]
    return spark.createDataFrame(rows, SCHEMA)


def sample(seed, n=120):
    rng = random.Random(seed)
    targets = [rng.randint(0, 1) for _ in range(n)]
    probs = [rng.choice([round(rng.random(), 1), min(1.0, max(0.0, t * 0.3 + rng.random() * 0.7))]) for t in targets]
    return targets, probs


def brute_auroc(targets, probs):
    pos = [p for t, p in zip(targets, probs) if t]
    neg = [p for t, p in zip(targets, probs) if not t]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def brute_roc(targets, probs):
    P, N = sum(targets), len(targets) - sum(targets)
    points = [(0.0, 0.0)]
    for cut in sorted(set(probs), reverse=True):
        points.append((
            sum(1 for t, p in zip(targets, probs) if p >= cut and not t) / N,
            sum(1 for t, p in zip(targets, probs) if p >= cut and t) / P,
        ))
    return points


def test_auroc_golden(spark):
    df = preds(spark, {1: ([0, 0, 1, 1, 1], [0.1, 0.4, 0.35, 0.8, 0.4])})
    assert evaluate.auroc(df).first()["auroc"] == 0.75


def test_auroc_matches_pair_counting(spark):
    runs = {i: sample(i) for i in range(4)}
    got = {r["run"]: r["auroc"] for r in evaluate.auroc(preds(spark, runs)).collect()}
    for run, (t, p) in runs.items():
        assert got[run] == pytest.approx(brute_auroc(t, p))
        squeezed = preds(spark, {run: (t, [x**3 / 1000 for x in p])})
        turned = preds(spark, {run: (t, [-x for x in p])})
        assert evaluate.auroc(squeezed).first()["auroc"] == pytest.approx(got[run])
        assert evaluate.auroc(turned).first()["auroc"] == pytest.approx(1 - got[run])


def test_average_ranks(spark):
    df = preds(spark, {1: ([0] * 5, [0.2, 0.1, 0.2, 0.9, 0.2])})
    got = {r["prob"]: r["avg_rank"] for r in evaluate.average_ranks(df).collect()}
    assert got == {0.1: 1.0, 0.2: 3.0, 0.9: 5.0}


def test_undefined_ratios_are_null(spark):
    df = preds(spark, {1: ([0, 1], [0.1, 0.2])})
    values = {r["metric"]: r["value"] for r in evaluate.run_metrics(df).collect()}
    assert values["ppv"] is None and values["f1"] is None and values["sensitivity"] == 0.0
    one_class = preds(spark, {1: ([1, 1], [0.1, 0.2])})
    assert evaluate.auroc(one_class).first()["auroc"] is None


def test_roc_and_interpolation(spark):
    runs = {i: sample(100 + i) for i in range(3)}
    df = preds(spark, runs)
    got = evaluate.roc_points(df).collect()
    for run, (t, p) in runs.items():
        want = sorted(brute_roc(t, p))
        assert np.allclose(sorted((r["fpr"], r["tpr"]) for r in got if r["run"] == run), want)
    for n in (2, 7, 100):
        at = evaluate.interpolate_roc(df, n_points=n).collect()
        assert len(at) == 3 * n
        for run, (t, p) in runs.items():
            x, y = zip(*brute_roc(t, p))
            want = np.interp(np.linspace(0, 1, n), x, y)
            want[0] = 0.0
            mine = [r["tpr"] for r in sorted((r for r in at if r["run"] == run), key=lambda r: r["j"])]
            # At a vertical step a grid point may fall on either end in floating point.
            near = [min(abs(m - w), abs(m - np.interp(g + 1e-9, x, y)), abs(m - np.interp(g - 1e-9, x, y)))
                    for m, w, g in zip(mine, want, np.linspace(0, 1, n))]
            assert max(near) < 1e-6
    mean = evaluate.mean_roc(df).collect()
    assert len(mean) == 3 and all(r["upper"] <= 1 for r in mean)


def test_precision_recall(spark):
    t, p = sample(7)
    df = preds(spark, {1: (t, p)})
    ap = area = 0.0
    last_r, last_q = 0.0, 1.0
    for cut in sorted(set(p), reverse=True):
        tp = sum(1 for a, b in zip(t, p) if b >= cut and a)
        r, q = tp / sum(t), tp / sum(1 for b in p if b >= cut)
        ap += (r - last_r) * q
        area += (r - last_r) * (q + last_q) / 2
        last_r, last_q = r, q
    assert evaluate.average_precision(df).first()["average_precision"] == pytest.approx(ap)
    assert evaluate.auprc(df).first()["auprc"] == pytest.approx(area)


def test_threshold_confusion(spark):
    t, p = sample(11)
    grid = evaluate.threshold_grid(0.0, 1.0, 11)
    assert grid == [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
    rows = evaluate.threshold_confusion(preds(spark, {1: (t, p)}), grid).collect()
    assert len(rows) == 11
    for r in rows:
        assert r["tp"] == sum(1 for a, b in zip(t, p) if a and b > r["threshold"])
        assert r["fp"] == sum(1 for a, b in zip(t, p) if not a and b > r["threshold"])
        assert r["tp"] + r["fp"] + r["tn"] + r["fn"] == len(t)


def metrics(spark, values, model="lr"):
    rows = [("ia", model, i, "ppv", v) for i, v in enumerate(values, start=1)]
    return spark.createDataFrame(rows, "task string, model string, run int, metric string, value double")


def test_best_run(spark):
    best = lambda values: tuple(evaluate.best_run_per_metric(metrics(spark, values)).select("value", "run", "model_name").first())
    assert best([0.5, 0.5, 0.1]) == (0.5, 1, "ia_seed_1")
    assert best([0.5, float("nan"), 0.7]) == (0.7, 3, "ia_seed_3")
    assert best([None, float("nan"), 0.0]) == (0.0, None, None)


def test_best_model_takes_the_first_of_equals(spark):
    rows = [("ia", m, "ppv", 50.0) for m in ("mlp", "avg-lr-rf", "rf")]
    df = spark.createDataFrame(rows, "task string, model string, metric string, value double")
    assert evaluate.best_model_per_metric(df, model_order()).first()["model"] == "rf"


def test_mean_ci(spark):
    row = evaluate.mean_ci(metrics(spark, [0.25] * 5), ["task", "model"]).first()
    assert (row["mean"], row["lower"], row["upper"]) == (0.25, 0.25, 0.25)
    row = evaluate.mean_ci(metrics(spark, [0.1, 0.2, 0.3]), ["task", "model"]).first()
    half = 4.302652729696 * 0.1 / math.sqrt(3)
    assert (row["lower"], row["upper"]) == (round(0.2 - half, 3), round(0.2 + half, 3))
    with pytest.raises(ValueError):
        evaluate.mean_ci(metrics(spark, [0.1]), ["task"], conf=1.0)


def test_student_t():
    assert quantile([0.975, 0.975, 0.95], [99, 9, 1]) == pytest.approx([1.984216951, 2.262157163, 6.313751515])
    assert two_sided_p([2.262157163, 0.0, 1.0], [9, 5, 1]) == pytest.approx([0.05, 1.0, 0.5])
    assert math.isnan(quantile([0.975], [0])[0]) and two_sided_p([np.inf], [3])[0] == 0.0


def test_ttest(spark):
    df = metrics(spark, [0.1, 0.2, 0.3]).union(metrics(spark, [0.1, 0.2, 0.3], "rf")).union(metrics(spark, [0.7, 0.8, 0.9], "gbm"))
    got = {r["pair"]: (r["t"], r["p"]) for r in ensemble.ttest_pairs(df).collect()}
    assert got == {"lr:rf": (0.0, 1.0), "lr:gbm": (-7.35, 0.001), "rf:gbm": (-7.35, 0.001)}
    flat = metrics(spark, [0.5, 0.5]).union(metrics(spark, [0.5, 0.5], "rf"))
    assert tuple(ensemble.ttest_pairs(flat).select("t", "p").first()) == (None, None)
    table = ensemble.ttest_table(ensemble.ttest_pairs(df), ["ppv"])
    assert table.count() == 3 and table.select("ppv.t").count() == 3


def test_ensembles(spark):
    targets = [0, 1, 1, 0]
    scores = {"lr": [0.1, 0.9, 0.4, 0.5], "rf": [0.3, 0.5, 0.2, 0.1], "gbm": [0.2] * 4, "mlp": [0.6] * 4}
    df = None
    for model, probs in scores.items():
        part = preds(spark, {1: (targets, probs)}, model)
        df = part if df is None else df.unionByName(part)
    out = ensemble.ensemble_predictions(df, with_members=True)
    assert out.count() == 26 * 4
    rows = {(r["model"], r["row_id"]): r for r in out.collect()}
    assert rows[("avg-lr-rf", 1)]["prob"] == pytest.approx(0.7)
    assert rows[("max-lr-rf", 3)]["prob"] == 0.5
    assert rows[("max-lr-rf", 3)]["threshold"] == 0.45 and rows[("max-lr-rf", 3)]["pred"] == 1
    assert rows[("avg-lr-rf", 3)]["threshold"] == pytest.approx(0.36) and rows[("avg-lr-rf", 3)]["pred"] == 0
    long = evaluate.run_metrics(out)
    assert long.count() == 26 * len(METRICS)
    incomplete = df.filter(~((F.col("model") == "rf") & (F.col("row_id") == 0)))
    assert ensemble.ensemble_max(incomplete).filter("model = 'max-lr-rf'").count() == 3
