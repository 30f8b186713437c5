import math
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import areas, ensemble, evaluate


def brute(rows):
    pos = [(-math.inf if p is None else p) for _, t, p in rows if t == 1]
    neg = [(-math.inf if p is None else p) for _, t, p in rows if t == 0]
    won = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
    return won / (len(pos) * len(neg)) if pos and neg else None


@pytest.mark.parametrize("range_scores", [7, 1 << 21])
def test_area_over_ranges_of_crowded_scores(spark, monkeypatch, range_scores):
    monkeypatch.setattr(areas, "RANGE_SCORES", range_scores)
    monkeypatch.setattr(areas, "PACK_ROWS", 50)
    draw = random.Random(5)
    rows = []
    for run in (1, 2, None):
        for _ in range(150):
            crowd = 0.5 + draw.choice([0, 1, 2, 3]) * 1e-12
            rows.append((run, draw.randint(0, 1), draw.choice([crowd, draw.random(), 0.0, 1.0, None])))
    rows += [(4, 1, 0.2), (4, 1, 0.4)]  # one class only
    preds = spark.createDataFrame(rows, "run int, target int, prob double").repartition(3).withColumn("pred", F.lit(0))
    got = {r["run"]: r for r in evaluate.run_summary(preds, ["run"]).collect()}
    assert set(got) == {1, 2, None, 4}
    for run, row in got.items():
        own = [r for r in rows if r[0] == run]
        want = brute(own)
        assert row["auroc"] == (None if want is None else pytest.approx(want, abs=1e-12))
        assert row["fn"] == sum(t for _, t, _ in own) and row["tn"] == len(own) - row["fn"]


def test_no_prediction_row_is_shuffled_by_its_score(spark):
    preds = spark.range(5000).selectExpr("int(id % 2) run", "int(id % 3 = 0) target", "(id % 997) / 997D prob", "0 pred")
    cells = {c: F.col("target") == k for c, k in (("tn", 0), ("fn", 1))} | {c: F.lit(False) for c in ("fp", "tp")}
    packed = areas.packed_scores(preds.repartition(4), ["run"], cells)
    assert packed.count() <= 4 * 2  # a row per run and task, not per score


def test_only_scores_of_variants_are_exploded(spark):
    rows = [("ia", m, 0, 1, 1, p) for m, p in (("lr", 0.1), ("rf", 0.2), ("gbm", 0.3), ("mlp", 0.4))]
    preds = spark.createDataFrame(rows, "task string, model string, run int, row_id long, target int, prob double")
    out = ensemble.ensemble_predictions(preds, with_members=True)
    assert "threshold:" not in out._jdf.queryExecution().analyzed().toString().split("Generate")[1].split("\n")[0]
    assert out.count() == 26
