"""Evaluation, curves, ensembles and significance tests over predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.config import METRICS, THRESHOLDS, model_order
from cohortlens.functions.scalar import round_metric
from cohortlens.operators import cohort, ensemble, evaluate, reshape
from cohortlens.plans import curves, results
from contract.registry import query, rounded
from contract.tables import N, P, notes, predictions

KEYS = "task, model, run"


def _cells(src: str) -> str:
    return f"""SELECT {KEYS}, count(*) FILTER (WHERE target = 0 AND pred = 0) AS tn,
      count(*) FILTER (WHERE target = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE target = 1 AND pred = 0) AS fn,
      count(*) FILTER (WHERE target = 1 AND pred = 1) AS tp FROM {src} GROUP BY {KEYS}"""


def _metrics(src: str) -> str:
    """Common table expressions from predictions to m(task, model, run, metric, value)."""
    return f"""c AS ({_cells(src)}),
      rk AS (SELECT {KEYS}, target, rank() OVER (PARTITION BY {KEYS} ORDER BY prob)
          + (count(*) OVER (PARTITION BY {KEYS}, prob) - 1) / 2 AS rk FROM {src}),
      au AS (SELECT {KEYS}, sum(target) AS np, count(*) - sum(target) AS nn, sum(CASE WHEN target = 1 THEN rk END) AS sr
          FROM rk GROUP BY {KEYS}),
      w AS (SELECT {KEYS}, tn, fp, fn, tp, tp / nullif(tp + fn, 0) AS sensitivity, tn / nullif(tn + fp, 0) AS specificity,
          tp / nullif(tp + fp, 0) AS ppv, tn / nullif(tn + fn, 0) AS npv,
          (fn + tp) / nullif(tn + fp + fn + tp, 0) AS prevalence,
          (sr - np * (np + 1) / 2) / nullif(np * nn, 0) AS auroc FROM c JOIN au USING (task, model, run)),
      w1 AS (SELECT *, 2 * sensitivity * ppv / nullif(sensitivity + ppv, 0) AS f1 FROM w),
      m AS (UNPIVOT (SELECT {KEYS}, sensitivity, specificity, ppv, auroc, npv, f1 FROM w1)
          ON sensitivity, specificity, ppv, auroc, npv, f1 INTO NAME metric VALUE value)"""


PM = f"{P}, {_metrics('p')}"


@query("agg_confusion", f"WITH {P} {_cells('p')}")
def agg_confusion(spark, d):
    return evaluate.confusion(predictions(spark, d))


@query(
    "agg_confusion_avg",
    f"""WITH {P}, c AS ({_cells('p')}) SELECT task, model, ceil(avg(tn))::BIGINT AS tn, ceil(avg(fp))::BIGINT AS fp,
      ceil(avg(fn))::BIGINT AS fn, ceil(avg(tp))::BIGINT AS tp FROM c GROUP BY 1, 2""",
)
def agg_confusion_avg(spark, d):
    return evaluate.confusion_avg(evaluate.confusion(predictions(spark, d)))


@query(
    "confusion_normalized",
    f"""WITH {P} SELECT {KEYS}, target AS true_label, pred AS pred_label,
      round(count(pred_is) / sum(count(pred_is)) OVER (PARTITION BY {KEYS}, target), 6) AS share
      FROM (SELECT {KEYS}, target, l.pred, CASE WHEN p.pred = l.pred THEN 1 END AS pred_is FROM p CROSS JOIN (VALUES (0), (1)) l(pred))
      GROUP BY {KEYS}, target, pred""",
)
def confusion_normalized(spark, d):
    out = evaluate.confusion_normalized(evaluate.confusion(predictions(spark, d)))
    return rounded(out, "share")


def _ratio_query(metric: str) -> None:
    @query(
        f"m_{metric}",
        f"WITH {PM} SELECT task, model, round_even(avg({metric}), 3) AS {metric} FROM w1 GROUP BY 1, 2",
    )
    def run(spark, d):
        return evaluate.ratio_mean(evaluate.confusion(predictions(spark, d)), metric)


for _metric in ("sensitivity", "specificity", "ppv", "npv", "f1", "prevalence"):
    _ratio_query(_metric)


@query("m_auroc", f"WITH {PM} SELECT {KEYS}, round(auroc, 6) AS auroc FROM w1")
def m_auroc(spark, d):
    return rounded(evaluate.auroc(predictions(spark, d)), "auroc")


@query("run_metrics", f"WITH {PM} SELECT {KEYS}, metric, round(value, 6) AS value FROM m")
def run_metrics(spark, d):
    return rounded(evaluate.run_metrics(predictions(spark, d)), "value")


@query(
    "single_run_report",
    f"""WITH {PM} SELECT {KEYS}, metric, round_even(value, 3) AS value FROM m
      UNION ALL SELECT {KEYS}, 'prevalence', round_even(prevalence, 3) FROM w1""",
)
def single_run_report(spark, d):
    return evaluate.single_run_report(predictions(spark, d), with_prevalence=True)


_DEFINED = """CASE metric WHEN 'sensitivity' THEN 'When it''s ACTUALLY YES, how often does it PREDICT YES?'
  WHEN 'specificity' THEN 'When it''s ACTUALLY NO, how often does it PREDICT NO?'
  WHEN 'ppv' THEN 'When it PREDICTS YES, how often is it correct?'
  WHEN 'auroc' THEN 'Indicates how well the model is capable of distinguishing between classes'
  WHEN 'npv' THEN 'When it PREDICTS NO, how often is it correct?'
  ELSE 'Harmonic mean of sensitivity and ppv' END"""


@query(
    "avg_metrics",
    f"""WITH {PM} SELECT task, model, metric, round(round_even(avg(value), 3) * 100, 6) AS value, {_DEFINED} AS definition
      FROM m GROUP BY task, model, metric""",
)
def avg_metrics(spark, d):
    return rounded(evaluate.avg_metrics(evaluate.run_metrics(predictions(spark, d)), definitions=True), "value")


# Quantile .975 of Student's t with 9 degrees of freedom: the table has 10 runs.
_T9 = "2.2621571627409915::DOUBLE"
_CI = f"""SELECT task, model, metric, avg(value) AS m, stddev_samp(value) / sqrt(count(value)) * {_T9} AS h
  FROM m GROUP BY task, model, metric"""


@query(
    "mean_ci",
    f"""WITH {PM}, q AS ({_CI}) SELECT task, model, metric, round_even(m, 3) AS mean, round_even(m - h, 3) AS lower,
      round_even(m + h, 3) AS upper FROM q""",
)
def mean_ci(spark, d):
    return evaluate.mean_ci(evaluate.run_metrics(predictions(spark, d)), ["task", "model", "metric"])


CI_SQL = f"""WITH {PM}, q AS ({_CI}) SELECT task, model, metric, round(round_even(m, 3) * 100, 6) AS mean,
  round(round_even(m - h, 3) * 100, 6) AS lower, round(round_even(m + h, 3) * 100, 6) AS upper FROM q"""


@query("avg_metrics_ci", CI_SQL)
def avg_metrics_ci(spark, d):
    out = evaluate.avg_metrics_ci(evaluate.run_metrics(predictions(spark, d)))
    return rounded(out, "mean", "lower", "upper")


@query(
    "best_model_per_metric",
    f"""WITH {PM}, a AS (SELECT task, model, metric, round_even(avg(value), 3) * 100 AS value FROM m GROUP BY 1, 2, 3)
    SELECT task, metric, model, round(value, 6) AS value FROM a
    QUALIFY row_number() OVER (PARTITION BY task, metric ORDER BY value DESC, list_position(['lr', 'rf', 'gbm', 'mlp'], model)) = 1""",
)
def best_model_per_metric(spark, d):
    averages = evaluate.avg_metrics(evaluate.run_metrics(predictions(spark, d)))
    return rounded(evaluate.best_model_per_metric(averages, model_order()), "value")


@query(
    "best_run_per_metric",
    f"""WITH {PM} SELECT task, model, metric, round(value, 6) AS value, run, task || '_seed_' || run AS model_name FROM m
      WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY task, model, metric ORDER BY value DESC, run) = 1""",
)
def best_run_per_metric(spark, d):
    return rounded(evaluate.best_run_per_metric(evaluate.run_metrics(predictions(spark, d))), "value")


@query(
    "rank_auc",
    f"""WITH {P} SELECT {KEYS}, row_id, prob, rank() OVER (PARTITION BY {KEYS} ORDER BY prob)
      + (count(*) OVER (PARTITION BY {KEYS}, prob) - 1) / 2 AS avg_rank FROM p""",
)
def rank_auc(spark, d):
    return evaluate.rank_rows(predictions(spark, d))


# --- curves -----------------------------------------------------------------------------------

_CURVE = f"""{P}, sc AS (SELECT {KEYS}, prob, sum(target)::BIGINT AS pos, (count(*) - sum(target))::BIGINT AS neg FROM p GROUP BY {KEYS}, prob),
  cu AS (SELECT {KEYS}, prob, pos, neg, (sum(pos) OVER o)::BIGINT AS cp, (sum(neg) OVER o)::BIGINT AS cn,
      (sum(pos) OVER k)::BIGINT AS ap, (sum(neg) OVER k)::BIGINT AS an FROM sc
    WINDOW o AS (PARTITION BY {KEYS} ORDER BY prob DESC ROWS UNBOUNDED PRECEDING), k AS (PARTITION BY {KEYS}))"""


@query(
    "roc_points",
    f"""WITH {_CURVE} SELECT {KEYS}, prob AS threshold, round(cn / an, 6) AS fpr, round(cp / ap, 6) AS tpr FROM cu
      UNION ALL SELECT DISTINCT {KEYS}, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM p""",
)
def roc_points(spark, d):
    return rounded(evaluate.roc_points(predictions(spark, d)), "fpr", "tpr")


@query(
    "pr_points",
    f"""WITH {_CURVE} SELECT {KEYS}, prob AS threshold, round(cp / ap, 6) AS recall, round(cp / (cp + cn), 6) AS precision FROM cu
      UNION ALL SELECT DISTINCT {KEYS}, NULL::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE FROM p""",
)
def pr_points(spark, d):
    return rounded(evaluate.pr_points(predictions(spark, d)), "recall", "precision")


@query("average_precision", f"WITH {_CURVE} SELECT {KEYS}, round(sum(pos / ap * (cp / (cp + cn))), 6) AS average_precision FROM cu GROUP BY {KEYS}")
def average_precision(spark, d):
    return rounded(evaluate.average_precision(predictions(spark, d)), "average_precision")


@query(
    "auprc",
    f"""WITH {_CURVE}, pr AS (SELECT {KEYS}, prob, cp / ap AS r, cp / (cp + cn) AS q FROM cu),
      st AS (SELECT {KEYS}, r - lag(r, 1, 0) OVER o AS dr, (q + lag(q, 1, 1) OVER o) / 2 AS h FROM pr
        WINDOW o AS (PARTITION BY {KEYS} ORDER BY prob DESC))
    SELECT {KEYS}, round(sum(dr * h), 6) AS auprc FROM st GROUP BY {KEYS}""",
)
def auprc(spark, d):
    return rounded(evaluate.auprc(predictions(spark, d)), "auprc")


def _interpolated(points: int) -> str:
    """i(task, model, run, j, x, tpr): nearest curve point at or left of x and the first one right of it."""
    last = points - 1
    return f"""{_CURVE}, pt AS (SELECT {KEYS}, cp, cn, ap, an FROM cu UNION ALL SELECT DISTINCT {KEYS}, 0, 0, ap, an FROM cu),
      nb AS (SELECT {KEYS}, range AS j, range / {last} AS x, max(ap) AS ap, max(an) AS an,
          max(cn) FILTER (WHERE cn * {last} <= range * an) AS bn, max(cp) FILTER (WHERE cn * {last} <= range * an) AS bp,
          min(cn) FILTER (WHERE cn * {last} > range * an) AS fn, min(cp) FILTER (WHERE cn * {last} > range * an) AS fp
        FROM pt CROSS JOIN range({points}) GROUP BY {KEYS}, range),
      i AS (SELECT {KEYS}, j, x, CASE WHEN j = 0 THEN 0 WHEN fn IS NULL THEN bp / ap
          ELSE bp / ap + (fp / ap - bp / ap) * (x - bn / an) / (fn / an - bn / an) END AS tpr FROM nb)"""


@query("join_interp_asof", f"WITH {_interpolated(21)} SELECT {KEYS}, j, round(x, 6) AS fpr, round(tpr, 6) AS tpr FROM i")
def join_interp_asof(spark, d):
    return rounded(evaluate.interpolate_roc(predictions(spark, d), n_points=21).drop("n"), "fpr", "tpr")


@query(
    "mean_roc",
    f"""WITH {_interpolated(10)} SELECT task, model, j, round(x, 6) AS fpr, round(avg(tpr), 6) AS tpr,
      round(avg(tpr) - stddev_pop(tpr), 6) + 0 AS lower, round(least(avg(tpr) + stddev_pop(tpr), 1), 6) AS upper
    FROM i GROUP BY task, model, j, x""",
)
def mean_roc(spark, d):
    return rounded(evaluate.mean_roc(predictions(spark, d)), "fpr", "tpr", "lower", "upper")


@query(
    "mean_roc_by_model",
    f"WITH {_interpolated(100)} SELECT task, model, j, round(x, 6) AS fpr, round(avg(tpr), 6) AS tpr FROM i GROUP BY task, model, j, x",
)
def mean_roc_by_model(spark, d):
    return rounded(evaluate.mean_roc_by_model(predictions(spark, d)), "fpr", "tpr")


def _sweep(points: int, low: float, high: float) -> str:
    return f"""{P}, gr AS (SELECT round({low}::DOUBLE + range * ({high}::DOUBLE - {low}::DOUBLE) / {points - 1}, 2) AS threshold FROM range({points})),
      tc AS (SELECT {KEYS}, threshold, count(*) FILTER (WHERE target = 1 AND prob > threshold) AS tp,
        count(*) FILTER (WHERE target = 0 AND prob > threshold) AS fp,
        count(*) FILTER (WHERE target = 1 AND prob <= threshold) AS fn,
        count(*) FILTER (WHERE target = 0 AND prob <= threshold) AS tn FROM p CROSS JOIN gr GROUP BY {KEYS}, threshold)"""


@query("join_threshold_grid", f"WITH {_sweep(21, 0.0, 1.0)} SELECT * FROM tc")
def join_threshold_grid(spark, d):
    return evaluate.threshold_confusion(predictions(spark, d), evaluate.threshold_grid(0.0, 1.0, 21))


@query(
    "threshold_sweep",
    f"""WITH {_sweep(40, 0.1, 0.9)}, r AS (SELECT {KEYS}, threshold, tp / nullif(tp + fn, 0) AS sensitivity,
        tn / nullif(tn + fp, 0) AS specificity, tp / nullif(tp + fp, 0) AS ppv, tn / nullif(tn + fn, 0) AS npv FROM tc),
      l AS (SELECT * FROM r UNPIVOT INCLUDE NULLS (value FOR metric IN (sensitivity, specificity, ppv, npv)))
    SELECT {KEYS}, threshold, metric, round_even(value, 3) AS value FROM l""",
)
def threshold_sweep(spark, d):
    return evaluate.threshold_sweep(predictions(spark, d), evaluate.threshold_grid(0.1, 0.9, 40))


@query(
    "stack_grid",
    f"""WITH {PM} SELECT {KEYS}, metric, value FROM (UNPIVOT (SELECT {KEYS}, tn, fp, fn, tp FROM c)
      ON tn, fp, fn, tp INTO NAME metric VALUE value)""",
)
def stack_grid(spark, d):
    cells = evaluate.confusion(predictions(spark, d))
    return evaluate.stack_grid(cells, ["task", "model", "run"], ["tn", "fp", "fn", "tp"])


@query(
    "youden_sweep",
    f"""WITH {_sweep(40, 0.1, 0.9)} SELECT {KEYS}, threshold,
      round(tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0), 6) AS youden_idx FROM tc""",
)
def youden_sweep(spark, d):
    out = evaluate.youden_sweep(predictions(spark, d), evaluate.threshold_grid(0.1, 0.9, 40))
    return rounded(out, "youden_idx")


_RANGED = f"""{N}, iv AS (SELECT trunc((relative_seconds - (SELECT max(relative_seconds) FROM n)) / 43200) / 2 + 0 AS interval, prob
  FROM n WHERE relative_seconds > -20 * 86400 AND relative_seconds < -86400)"""


@query("prob_by_interval", f"WITH {_RANGED} SELECT round(-ln(1 - interval), 6) + 0 AS interval, round(avg(prob), 6) AS prob FROM iv GROUP BY 1")
def prob_by_interval(spark, d):
    timed = cohort.with_relative_time(notes(spark, d))
    return rounded(curves.prob_by_interval(timed, log_axis=True), "interval", "prob")


@query("agg_interval_mean", f"WITH {_RANGED} SELECT interval, round(avg(prob), 6) AS prob FROM iv GROUP BY 1")
def agg_interval_mean(spark, d):
    return rounded(curves.prob_by_interval(cohort.with_relative_time(notes(spark, d))), "interval", "prob")


@query("agg_self_weighted_mean", f"WITH {_RANGED} SELECT interval, round(sum(prob * prob) / nullif(sum(prob), 0), 6) AS prob FROM iv GROUP BY 1")
def agg_self_weighted_mean(spark, d):
    timed = cohort.with_relative_time(notes(spark, d))
    return rounded(curves.prob_by_interval(timed, self_weighted=True), "interval", "prob")


# --- ensembles ----------------------------------------------------------------------------------

_MEMBERS = """en AS (SELECT key, unnest(string_split(key, '-')) AS model FROM (SELECT unnest(['gbm-mlp', 'rf-mlp', 'rf-gbm',
    'rf-gbm-mlp', 'lr-mlp', 'lr-gbm', 'lr-gbm-mlp', 'lr-rf', 'lr-rf-mlp', 'lr-rf-gbm', 'lr-rf-gbm-mlp']) AS key))"""
_ENSEMBLES = f"""{P}, {_MEMBERS},
  et AS (SELECT task, key, avg(threshold) AS ta, max(threshold) AS tm FROM en JOIN th USING (model) GROUP BY 1, 2),
  eg AS (SELECT task, key, run, row_id, max(target) AS target, avg(prob) AS pa, max(prob) AS pm
    FROM p JOIN en USING (model) GROUP BY ALL),
  ea AS (SELECT task, 'avg-' || key AS model, run, row_id, target, pa AS prob, CAST(pa > ta AS INTEGER) AS pred, ta AS threshold FROM eg JOIN et USING (task, key)),
  em AS (SELECT task, 'max-' || key AS model, run, row_id, target, pm AS prob, CAST(pm > tm AS INTEGER) AS pred, tm AS threshold FROM eg JOIN et USING (task, key)),
  e AS (SELECT * FROM ea UNION ALL SELECT * FROM em)"""


def _ensemble_columns(df):
    return rounded(df.select("task", "model", "run", "row_id", "target", "prob", "pred"), "prob", places=9)


_ENSEMBLE_ROWS = "SELECT task, model, run, row_id, target, round(prob, 9) AS prob, pred FROM"


@query("ensemble_avg", f"WITH {_ENSEMBLES} {_ENSEMBLE_ROWS} ea")
def ensemble_avg(spark, d):
    return _ensemble_columns(ensemble.ensemble_avg(predictions(spark, d)))


@query("ensemble_max", f"WITH {_ENSEMBLES} {_ENSEMBLE_ROWS} em")
def ensemble_max(spark, d):
    return _ensemble_columns(ensemble.ensemble_max(predictions(spark, d)))


@query("join_align_models", f"WITH {P} SELECT task, run, row_id, target, lr, rf, gbm, mlp FROM pw")
def join_align_models(spark, d):
    return ensemble.align_models(predictions(spark, d))


@query("metric_label", f"WITH {_ENSEMBLES} SELECT task, model, count(*) AS n_rows FROM e GROUP BY 1, 2")
def metric_label(spark, d):
    return ensemble.ensemble_predictions(predictions(spark, d)).groupBy("task", "model").agg(F.count("*").alias("n_rows"))


@query(
    "ensemble_thresholds",
    f"""WITH {_ENSEMBLES} SELECT task, model, round_even(max(threshold), 3) AS threshold, sum(pred)::BIGINT AS n_positive
      FROM e GROUP BY 1, 2""",
)
def ensemble_thresholds(spark, d):
    return ensemble.ensemble_thresholds(ensemble.ensemble_predictions(predictions(spark, d)))


_ALL = f"""{_ENSEMBLES}, al AS (SELECT {KEYS}, row_id, target, prob, pred FROM p
  UNION ALL SELECT {KEYS}, row_id, target, prob, pred FROM e), {_metrics('al')}"""


@query(
    "ensemble_metrics",
    f"""WITH {_ALL} PIVOT (SELECT task, model, metric, round(round_even(avg(value), 3) * 100, 6) AS value FROM m GROUP BY 1, 2, 3)
      ON metric IN ('sensitivity', 'specificity', 'ppv', 'auroc', 'npv', 'f1') USING first(value) GROUP BY task, model""",
)
def ensemble_metrics(spark, d):
    averages = evaluate.avg_metrics(results.ensemble_run_metrics(predictions(spark, d)))
    return rounded(reshape.transpose_metrics(averages, ["task", "model"], METRICS), *METRICS)


@query(
    "transpose_metrics",
    f"""WITH {PM} PIVOT (SELECT {KEYS}, metric, round_even(value, 3) AS value FROM m)
      ON metric IN ('sensitivity', 'specificity', 'ppv', 'auroc', 'npv', 'f1') USING first(value) GROUP BY {KEYS}""",
)
def transpose_metrics(spark, d):
    long = evaluate.run_metrics(predictions(spark, d)).withColumn("value", round_metric(F.col("value")))
    return reshape.transpose_metrics(long, ["task", "model", "run"], METRICS)


_ORDER = "[" + ", ".join(f"'{m}'" for m in model_order()) + "]"


@query(
    "join_model_pairs",
    f"""WITH {_ENSEMBLES}, al AS (SELECT DISTINCT task, model FROM p UNION SELECT DISTINCT task, model FROM e)
    SELECT a.task, a.model AS model1, b.model AS model2 FROM al a JOIN al b
      ON a.task = b.task AND list_position({_ORDER}, a.model) < list_position({_ORDER}, b.model)""",
)
def join_model_pairs(spark, d):
    everything = ensemble.ensemble_predictions(predictions(spark, d), with_members=True)
    return ensemble.model_pairs(everything.select("task", "model").distinct())


# Two-sided p of Student's t for an even number of degrees of freedom is a finite sum; here 18.
_SUM18 = " + ".join(
    f"{c}::DOUBLE / {q} * pow(cos(atan(t / sqrt(18))), {2 * i})"
    for i, (c, q) in enumerate([(1, 1), (1, 2), (3, 8), (5, 16), (35, 128), (63, 256), (231, 1024), (429, 2048), (6435, 32768)])
)


@query(
    "ttest_pairs",
    f"""WITH {_ALL}, st AS (SELECT task, model, metric, count(value) AS n, avg(value) AS mu, var_samp(value) AS v FROM m GROUP BY 1, 2, 3),
      pr AS (SELECT a.task, a.model || ':' || b.model AS pair, a.metric,
          (a.mu - b.mu) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)) AS t
        FROM st a JOIN st b ON a.task = b.task AND a.metric = b.metric
          AND list_position({_ORDER}, a.model) < list_position({_ORDER}, b.model))
    SELECT task, pair, metric, round_even(t, 2) + 0 AS t,
      greatest(round_even(1 - abs(sin(atan(t / sqrt(18)))) * ({_SUM18}), 2), 0.001::DOUBLE) AS p FROM pr""",
)
def ttest_pairs(spark, d):
    return rounded(ensemble.ttest_pairs(results.ensemble_run_metrics(predictions(spark, d))), "t")
