"""Evaluation over one long predictions table.

Columns: task, model, run, row_id, target, prob, pred. A single run may hold a
large share of the table, so no window spans a run's rows: rows with equal scores
are counted first, and sums over lower or higher scores come from score buckets
(see ``ordering``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.config import METRIC_DEFINITIONS, METRICS
from cohortlens.functions.scalar import round_metric, threshold_predict
from cohortlens.functions.student_t import t_quantile
from cohortlens.operators import areas
from cohortlens.operators.ordering import falling_levels, running_sums, score_levels
from cohortlens.storage import materialize, small_side

RUN = ("task", "model", "run")
MODEL = ("task", "model")
CELLS = ("tn", "fp", "fn", "tp")
HEAVY_TIE = 10_000  # rows of a run with one score, from which they do not join by score


def with_threshold(preds: DataFrame, threshold: Column | float) -> DataFrame:
    return preds.withColumn("pred", threshold_predict(F.col("prob"), threshold))


def _cells(target: Column, pred: Column) -> dict[str, Column]:
    return {
        "tn": (target == 0) & (pred == 0),
        "fp": (target == 0) & (pred == 1),
        "fn": (target == 1) & (pred == 0),
        "tp": (target == 1) & (pred == 1),
    }


def confusion(preds: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """The four cells per run, always all four."""
    cells = _cells(F.col("target"), F.col("pred"))
    return preds.groupBy(*keys).agg(*[F.count_if(c).alias(name) for name, c in cells.items()])


def confusion_avg(cells: DataFrame, keys: Sequence[str] = MODEL) -> DataFrame:
    """Mean cells over runs, rounded up."""
    return cells.groupBy(*keys).agg(*[F.ceil(F.avg(c)).cast("long").alias(c) for c in CELLS])


def confusion_normalized(cells: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Cells as shares of their true class: (.., true_label, pred_label, share)."""
    entry = lambda true, pred, cell, other: F.struct(
        F.lit(true).alias("true_label"),
        F.lit(pred).alias("pred_label"),
        F.try_divide(F.col(cell), F.col(cell) + F.col(other)).alias("share"),
    )
    table = F.array(
        entry(0, 0, "tn", "fp"), entry(0, 1, "fp", "tn"), entry(1, 0, "fn", "tp"), entry(1, 1, "tp", "fn")
    )
    return cells.select(*keys, F.explode(table).alias("e")).select(*keys, "e.*")


def sensitivity() -> Column:
    return F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))


def specificity() -> Column:
    return F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))


def ppv() -> Column:
    return F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))


def npv() -> Column:
    return F.try_divide(F.col("tn"), F.col("tn") + F.col("fn"))


def f1() -> Column:
    return F.try_divide(2 * sensitivity() * ppv(), sensitivity() + ppv())


def prevalence() -> Column:
    return F.try_divide(F.col("fn") + F.col("tp"), F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))


RATIOS = {
    "sensitivity": sensitivity,
    "specificity": specificity,
    "ppv": ppv,
    "npv": npv,
    "f1": f1,
    "prevalence": prevalence,
}


def ratio(cells: DataFrame, metric: str, keys: Sequence[str] = RUN) -> DataFrame:
    """One ratio per run."""
    return cells.select(*keys, RATIOS[metric]().alias(metric))


def ratio_mean(cells: DataFrame, metric: str, keys: Sequence[str] = MODEL, places: int = 3) -> DataFrame:
    return cells.groupBy(*keys).agg(round_metric(F.avg(RATIOS[metric]()), places).alias(metric))


def run_summary(preds: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Confusion cells and exact ROC area per run, from one pass over the predictions.

    The area counts, for every positive, the negatives below it and half of those
    tied with it (see ``areas``).
    """
    keys = list(keys)
    pairs = areas.cells_and_pairs(preds, keys, _cells(F.col("target"), F.col("pred")))
    return pairs.select(
        *keys,
        *CELLS,
        F.try_divide(F.col("won"), F.col("pos").cast("double") * F.col("neg")).alias("auroc"),
    )


def auroc(preds: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    scored = preds if "pred" in preds.columns else preds.withColumn("pred", F.lit(0))
    return run_summary(scored, keys).select(*keys, "auroc")


def _long(summary: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    values = {m: (F.col("auroc") if m == "auroc" else RATIOS[m]()) for m in metrics}
    entries = F.array(
        *[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()]
    )
    return summary.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")


def run_metrics(preds: DataFrame, keys: Sequence[str] = RUN, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Long table of per-run metrics: (task, model, run, metric, value)."""
    return _long(run_summary(preds, keys), keys, metrics)


def single_run_report(
    preds: DataFrame, keys: Sequence[str] = RUN, with_prevalence: bool = False, places: int = 3
) -> DataFrame:
    metrics = (*METRICS, "prevalence") if with_prevalence else METRICS
    return run_metrics(preds, keys, metrics).withColumn("value", round_metric(F.col("value"), places))


def with_definition(metrics: DataFrame) -> DataFrame:
    text = F.when(F.lit(False), F.lit(None).cast("string"))
    for metric, definition in METRIC_DEFINITIONS.items():
        text = text.when(F.col("metric") == metric, definition)
    return metrics.withColumn("definition", text)


def avg_metrics(
    metrics: DataFrame, keys: Sequence[str] = MODEL, places: int = 3, definitions: bool = False
) -> DataFrame:
    """Mean per metric in percent, rounded before the scaling."""
    out = metrics.groupBy(*keys, "metric").agg(
        (round_metric(F.avg("value"), places) * 100).alias("value")
    )
    return with_definition(out) if definitions else out


def mean_ci(metrics: DataFrame, keys: Sequence[str], conf: float = 0.95, places: int = 3) -> DataFrame:
    """Mean with its Student t interval: (keys, mean, lower, upper)."""
    if not 0 < conf < 1:
        raise ValueError(f"confidence must lie in (0, 1), got {conf}")
    spread = metrics.groupBy(*keys).agg(
        F.avg("value").alias("m"),
        F.try_divide(F.stddev_samp("value"), F.sqrt(F.count("value"))).alias("se"),
        F.count("value").alias("n"),
    )
    half = F.col("se") * t_quantile(F.lit((1 + conf) / 2), (F.col("n") - 1).cast("double"))
    return spread.withColumn("h", half).select(
        *keys,
        round_metric(F.col("m"), places).alias("mean"),
        round_metric(F.col("m") - F.col("h"), places).alias("lower"),
        round_metric(F.col("m") + F.col("h"), places).alias("upper"),
    )


def avg_metrics_ci(
    metrics: DataFrame, keys: Sequence[str] = MODEL, conf: float = 0.95, definitions: bool = False
) -> DataFrame:
    out = mean_ci(metrics, [*keys, "metric"], conf).withColumns(
        {c: F.col(c) * 100 for c in ("mean", "lower", "upper")}
    )
    return with_definition(out) if definitions else out


def best_run_per_metric(metrics: DataFrame, keys: Sequence[str] = MODEL) -> DataFrame:
    """Run with the largest positive value per metric, the first of equals; (0, null) if none."""
    usable = F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") > 0)
    entry = F.struct(F.col("value"), (-F.col("run")).alias("early"))
    best = metrics.groupBy(*keys, "metric").agg(F.max(F.when(usable, entry)).alias("b"))
    run = -F.col("b.early")
    name = F.concat(F.col("task"), F.lit("_")) if "task" in keys else F.lit("")
    return best.select(
        *keys,
        "metric",
        F.coalesce("b.value", F.lit(0.0)).alias("value"),
        run.alias("run"),
        F.concat(name, F.lit("seed_"), run.cast("string")).alias("model_name"),
    )


def best_model_per_metric(averages: DataFrame, order: Sequence[str], keys: Sequence[str] = ("task",)) -> DataFrame:
    """Model with the highest average per metric, the first in ``order`` among equals."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    return (
        averages.groupBy(*keys, "metric")
        .agg(F.max(F.struct(F.col("value"), (-place).alias("early"), F.col("model"))).alias("b"))
        .select(*keys, "metric", "b.model", "b.value")
    )


def score_counts(preds: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Positives and negatives per distinct score."""
    return preds.groupBy(*keys, "prob").agg(
        F.count_if(F.col("target") == 1).alias("pos"), F.count_if(F.col("target") == 0).alias("neg")
    )


def average_ranks(preds: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Ascending rank of each distinct score, ties sharing their mean rank."""
    counts = score_counts(preds, keys).withColumn("n", F.col("pos") + F.col("neg"))
    source = preds.withColumn("n", F.lit(1).cast("long"))
    ranked = running_sums(counts, keys, score_levels(F.col("prob")), ["prob"], ["n"], source)
    return ranked.select(
        *keys, "prob", "n", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias("avg_rank")
    )


def rank_rows(preds: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Every prediction with its average rank.

    Scores that many rows of a run share are few: they meet their rank map-side if the
    list of them, counted, is short. The other rows join it by score.
    """
    on = [*keys, "prob"]
    ranks = materialize(average_ranks(preds, keys), "ranks")
    tied = small_side(ranks.filter(F.col("n") >= HEAVY_TIE).select(*on, "avg_rank"), "heavy_ties")
    alone = ranks.filter(F.col("n") < HEAVY_TIE).select(*on, "avg_rank")
    met = preds.join(tied, on).select(*keys, "row_id", "prob", "avg_rank")
    others = preds.join(tied.select(*on), on, "left_anti").join(alone, on)
    return met.unionByName(others.select(*keys, "row_id", "prob", "avg_rank"))


def curve_counts(preds: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Per distinct score: positives and negatives at it, at or above it, and in the run."""
    counts = score_counts(preds, keys).withColumn("down", -F.col("prob"))
    source = preds.select(
        *keys,
        "prob",
        (F.col("target") == 1).cast("long").alias("pos"),
        (F.col("target") == 0).cast("long").alias("neg"),
    )
    levels = falling_levels(F.col("prob"))
    return running_sums(counts, keys, levels, ["down"], ["pos", "neg"], source).drop("down")


def roc_points(preds: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """(threshold, fpr, tpr) at each distinct score, with the start (null, 0, 0) of each run."""
    points = curve_counts(preds, keys).select(
        *keys,
        F.col("prob").alias("threshold"),
        F.try_divide("cum_neg", "all_neg").alias("fpr"),
        F.try_divide("cum_pos", "all_pos").alias("tpr"),
    )
    start = preds.select(*keys).distinct().select(
        *keys, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


def interpolate_roc(preds: DataFrame, keys: Sequence[str] = RUN, n_points: int | None = None,
                    curve: Sequence[str] = MODEL) -> DataFrame:
    """True positive rate of every run at evenly spaced false positive rates.

    Returns (keys, j, n, fpr, tpr) for j = 0 .. n-1 at fpr = j / (n-1). Without
    ``n_points`` a curve gets as many points as it has runs. Points of a run are
    first reduced to the lowest and highest one per grid cell, compared in whole
    numbers, so the nearest-point search only sees n rows per run.
    """
    keys, curve = list(keys), list(curve)
    points = curve_counts(preds, keys).filter((F.col("all_pos") > 0) & (F.col("all_neg") > 0))
    if n_points is None:
        # One row per model: as small as the study has models.
        runs = preds.groupBy(*curve).agg(F.count_distinct("run").alias("n"))
        points = points.join(F.broadcast(runs), curve)
    else:
        points = points.withColumn("n", F.lit(int(n_points)).cast("long"))
    fpr = F.col("cum_neg") / F.col("all_neg")
    point = F.struct(fpr.alias("x"), (F.col("cum_pos") / F.col("all_pos")).alias("y"))
    # Ceiling in whole numbers: the first grid point at or right of the point.
    cell = F.expr("(cum_neg * greatest(n - 1, 1) + all_neg - 1) div all_neg")
    cells = points.groupBy(*keys, "n", cell.alias("cell")).agg(F.max(point).alias("hi"), F.min(point).alias("lo"))
    # Grid points up to the next filled cell lie between this cell's last point and
    # the next cell's first one; those before the first cell start from (0, 0).
    order = Window.partitionBy(*keys).orderBy("cell")
    stretches = cells.select(
        *keys,
        "n",
        "cell",
        "hi",
        "lo",
        F.coalesce(F.lead("cell").over(order), F.col("n")).alias("until"),
        F.lead("lo").over(order).alias("next"),
        F.lag("cell").over(order).isNull().alias("first"),
    )
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def stretch(low: Column, high: Column, before: Column, after: Column) -> Column:
        places = F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(places, lambda j: F.struct(j.alias("j"), before.alias("b"), after.alias("a")))

    leading = stretch(F.lit(0).cast("long"), F.when(F.col("first"), F.col("cell")).otherwise(0), start, F.col("lo"))
    own = stretch(F.col("cell"), F.col("until"), F.col("hi"), F.col("next"))
    at = stretches.select(*keys, "n", F.explode(F.concat(leading, own)).alias("p")).select(*keys, "n", "p.*")
    x = F.col("j") / F.greatest(F.col("n") - 1, F.lit(1))
    slope = F.try_divide(F.col("a.y") - F.col("b.y"), F.col("a.x") - F.col("b.x"))
    y = F.col("b.y") + F.coalesce(slope * (x - F.col("b.x")), F.lit(0.0))
    return at.select(*keys, "n", "j", x.alias("fpr"), F.when(F.col("j") == 0, 0.0).otherwise(y).alias("tpr"))


def mean_roc(preds: DataFrame, keys: Sequence[str] = MODEL, n_points: int | None = None) -> DataFrame:
    """Mean curve over runs with a band of one population deviation, capped above only."""
    runs = interpolate_roc(preds, [*keys, "run"], n_points, keys)
    mean, dev = F.avg("tpr"), F.stddev_pop("tpr")
    return runs.groupBy(*keys, "j", "fpr").agg(
        mean.alias("tpr"), (mean - dev).alias("lower"), F.least(mean + dev, F.lit(1.0)).alias("upper")
    )


def mean_roc_by_model(preds: DataFrame, n_points: int = 100, keys: Sequence[str] = MODEL) -> DataFrame:
    return mean_roc(preds, keys, n_points).drop("lower", "upper")


def pr_points(preds: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """(threshold, recall, precision) at each distinct score, with the end (null, 0, 1)."""
    points = curve_counts(preds, keys).select(
        *keys,
        F.col("prob").alias("threshold"),
        F.try_divide("cum_pos", "all_pos").alias("recall"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
    )
    end = preds.select(*keys).distinct().select(
        *keys, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision")
    )
    return points.unionByName(end)


def _pr_terms() -> tuple[Column, Column, Column]:
    """Step in recall, precision at a score and precision just above it."""
    step = F.try_divide(F.col("pos"), F.col("all_pos"))
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    tp, fp = F.col("cum_pos") - F.col("pos"), F.col("cum_neg") - F.col("neg")
    return step, precision, F.coalesce(F.try_divide(tp, tp + fp), F.lit(1.0))


def average_precision(preds: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    step, precision, _ = _pr_terms()
    return curve_counts(preds, keys).groupBy(*keys).agg(F.sum(step * precision).alias("average_precision"))


def auprc(preds: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Trapezoid area below the precision-recall curve."""
    step, precision, before = _pr_terms()
    return curve_counts(preds, keys).groupBy(*keys).agg(
        F.sum(step * (precision + before) / 2).alias("auprc")
    )


def threshold_grid(low: float = 0.0, high: float = 1.0, n: int = 5) -> list[float]:
    """Evenly spaced thresholds, rounded to two places."""
    width = (high - low) / (n - 1) if n > 1 else 0.0
    return [round(low + i * width, 2) for i in range(n)]


def threshold_confusion(
    preds: DataFrame, grid: Sequence[float], keys: Sequence[str] = RUN
) -> DataFrame:
    """Confusion cells of every run at every threshold.

    A prediction is positive for exactly the thresholds below it, so rows are
    counted once by how many thresholds they pass; the grid only meets these
    counts, at most one more than there are thresholds per run and class.
    """
    ascending = sorted(grid)
    passed = reduce(lambda a, b: a + b, [(F.col("prob") > t).cast("int") for t in ascending])
    counts = (
        preds.withColumn("passed", passed)
        .groupBy(*keys, "passed")
        .agg(F.count_if(F.col("target") == 1).alias("pos"), F.count_if(F.col("target") == 0).alias("neg"))
    )
    entries = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(ascending)]
    )
    hit = F.col("e.i") < F.col("passed")
    return (
        counts.withColumn("e", F.explode(entries))
        .groupBy(*keys, "e.i", "e.threshold")
        .agg(
            F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"),
            F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"),
            F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        )
        .drop("i")
    )


def stack_grid(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return wide.unpivot(list(keys), list(metrics), "metric", "value")


def threshold_sweep(preds: DataFrame, grid: Sequence[float], keys: Sequence[str] = RUN, places: int = 3) -> DataFrame:
    """Four ratios per run and threshold: (.., threshold, metric, value)."""
    metrics = ("sensitivity", "specificity", "ppv", "npv")
    wide = threshold_confusion(preds, grid, keys).select(
        *keys, "threshold", *[round_metric(RATIOS[m](), places).alias(m) for m in metrics]
    )
    return stack_grid(wide, [*keys, "threshold"], metrics)


def youden_sweep(preds: DataFrame, grid: Sequence[float], keys: Sequence[str] = RUN) -> DataFrame:
    """Sensitivity plus specificity per run and threshold."""
    return threshold_confusion(preds, grid, keys).select(
        *keys, "threshold", (sensitivity() + specificity()).alias("youden_idx")
    )


def self_weighted_mean(prob: Column) -> Column:
    return F.try_divide(F.sum(prob * prob), F.sum(prob))
