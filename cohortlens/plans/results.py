"""From predictions to the tables of the result analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortlens.config import METRICS, model_order
from cohortlens.operators import ensemble, evaluate, reshape
from cohortlens.storage import materialize


def ensemble_run_metrics(preds: DataFrame) -> DataFrame:
    """Per-run metrics of all single models and ensembles."""
    return evaluate.run_metrics(ensemble.ensemble_predictions(preds, with_members=True))


def result_tables(preds: DataFrame) -> dict[str, DataFrame]:
    """Metric table, best models, intervals and t-tests from one stored metrics table."""
    metrics = materialize(ensemble_run_metrics(preds), "run_metrics")
    averages = evaluate.avg_metrics(metrics)
    return {
        "run_metrics": metrics,
        "metrics": reshape.transpose_metrics(averages, ["task", "model"], METRICS),
        "best": evaluate.best_model_per_metric(averages, model_order()),
        "intervals": evaluate.avg_metrics_ci(metrics),
        "ttests": ensemble.ttest_pairs(metrics),
    }
