"""Model ensembles and pairwise significance tests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.config import ENSEMBLES, MODELS, THRESHOLDS, model_order
from cohortlens.functions.scalar import round_metric, threshold_predict
from cohortlens.functions.student_t import t_two_sided_p

Thresholds = Mapping[str, Mapping[str, float]]


def align_models(preds: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """One row per task, run and row id, one score column per model."""
    return preds.groupBy("task", "run", "row_id").agg(
        F.max("target").alias("target"),
        *[F.max(F.when(F.col("model") == m, F.col("prob"))).alias(m) for m in models],
    )


def _by_task(values: Mapping[str, Column]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for task, value in values.items():
        out = out.when(F.col("task") == task, value)
    return out


def member_threshold(thresholds: Thresholds, members: Sequence[str], kind: str) -> dict[str, float]:
    """Threshold of an ensemble per task: mean or maximum of its members' thresholds."""
    combine = (lambda v: sum(v) / len(v)) if kind == "avg" else max
    return {task: combine([by_model[m] for m in members]) for task, by_model in thresholds.items()}


def _variant(kind: str, members: Sequence[str], thresholds: Thresholds) -> tuple[str, Column, dict[str, float]]:
    """Name, score and threshold per task."""
    probs = [F.col(m) for m in members]
    if kind == "avg":
        total = probs[0]
        for p in probs[1:]:
            total = total + p
        prob = total / len(probs)
    elif kind == "max":
        # greatest() skips nulls; a row some member did not score has no ensemble score.
        complete = probs[0].isNotNull()
        for p in probs[1:]:
            complete = complete & p.isNotNull()
        prob = F.when(complete, F.greatest(*probs))
    else:
        prob = probs[0]
    name = members[0] if kind == "single" else f"{kind}-{'-'.join(members)}"
    limit = member_threshold(thresholds, members, "max" if kind == "single" else kind)
    return name, prob, limit


def _explode_variants(wide: DataFrame, variants: Sequence[tuple[str, Column, dict[str, float]]]) -> DataFrame:
    """Only scores are exploded; names and thresholds are looked up by the place of the variant."""
    names, probs, limits = zip(*variants)
    listed = lambda values: F.array(*[F.lit(v) for v in values])[F.col("at")]
    threshold = _by_task({task: listed([float(limit[task]) for limit in limits]) for task in limits[0]})
    return (
        wide.select("task", "run", "row_id", "target", F.posexplode(F.array(*probs)).alias("at", "prob"))
        .filter(F.col("prob").isNotNull())
        .select("task", listed(names).alias("model"), "run", "row_id", "target", "prob", threshold.alias("threshold"))
        .withColumn("pred", threshold_predict(F.col("prob"), F.col("threshold")))
    )


def ensemble_predictions(
    preds: DataFrame,
    kinds: Sequence[str] = ("avg", "max"),
    ensembles: Sequence[Sequence[str]] = ENSEMBLES,
    thresholds: Thresholds = THRESHOLDS,
    models: Sequence[str] = MODELS,
    with_members: bool = False,
) -> DataFrame:
    """Predictions of all ensembles from one alignment of the member scores.

    The table is shuffled once, on (task, run, row id); every ensemble is then an
    expression over the aligned row. ``with_members`` adds the single models.
    """
    variants = [_variant("single", [m], thresholds) for m in models] if with_members else []
    for members in ensembles:
        variants += [_variant(kind, members, thresholds) for kind in kinds]
    return _explode_variants(align_models(preds, models), variants)


def ensemble_avg(preds: DataFrame, **options) -> DataFrame:
    return ensemble_predictions(preds, kinds=("avg",), **options)


def ensemble_max(preds: DataFrame, **options) -> DataFrame:
    return ensemble_predictions(preds, kinds=("max",), **options)


def ensemble_thresholds(ensemble_preds: DataFrame) -> DataFrame:
    """Threshold of every ensemble found in a predictions table, rounded to three places."""
    return ensemble_preds.groupBy("task", "model").agg(
        round_metric(F.max("threshold"), 3).alias("threshold"),
        F.count_if(F.col("pred") == 1).alias("n_positive"),
    )


def _pairs(table: DataFrame, keys: Sequence[str], fields: Sequence[str], order: Sequence[str] | None) -> DataFrame:
    """Every unordered pair of models per key, in the given order, as structs a and b.

    A key has one row per model of the study, so its models fit one array.
    """
    place = F.array_position(F.array(*[F.lit(m) for m in order or model_order()]), F.col("model"))
    listed = table.groupBy(*keys).agg(
        F.collect_list(F.struct(place.alias("place"), *fields)).alias("models")
    )
    return (
        listed.select(*keys, "models", F.explode("models").alias("a"))
        .select(*keys, "a", F.explode("models").alias("b"))
        .filter(F.col("a.place") < F.col("b.place"))
    )


def model_pairs(models: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """All unordered pairs of the models of a task, in the given order."""
    return _pairs(models, ["task"], ["model"], order).select(
        "task", F.col("a.model").alias("model1"), F.col("b.model").alias("model2")
    )


def ttest_pairs(metrics: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Equal-variance t-test for every model pair and metric: (task, pair, metric, t, p)."""
    stats = metrics.groupBy("task", "model", "metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v")
    )
    pairs = _pairs(stats, ["task", "metric"], ["model", "n", "m", "v"], order)
    freedom = lambda side: F.col(f"{side}.n") - 1
    df = freedom("a") + freedom("b")
    pooled = F.try_divide(freedom("a") * F.col("a.v") + freedom("b") * F.col("b.v"), df)
    scale = F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("a.n")) + F.try_divide(F.lit(1.0), F.col("b.n"))))
    tested = pairs.withColumn("df", df.cast("double")).withColumn(
        "t_raw", F.try_divide(F.col("a.m") - F.col("b.m"), scale)
    )
    p = F.nanvl(t_two_sided_p(F.col("t_raw"), F.col("df")), F.lit(None).cast("double"))
    return tested.withColumn("p_raw", p).select(
        "task",
        F.concat_ws(":", "a.model", "b.model").alias("pair"),
        "metric",
        F.bround("t_raw", 2).alias("t"),
        F.when(F.col("p_raw").isNotNull(), F.greatest(F.bround("p_raw", 2), F.lit(0.001))).alias("p"),
    )


def ttest_table(tests: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Pair rows, one (t, p) struct column per metric."""
    return (
        tests.groupBy("task", "pair").pivot("metric", list(metrics)).agg(F.first(F.struct("t", "p")))
    )
