"""Schemas, scans and sinks of the study's tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators.ordering import running_sums

# Column names and types of the raw notes.
NOTES_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("subject_id", T.LongType()),
        T.StructField("hadm_id", T.LongType()),
        T.StructField("category", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ethnicity", T.StringType()),
        T.StructField("admission_type", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("admission_age", T.DoubleType()),
        T.StructField("charttime", T.TimestampType()),
        T.StructField("intime", T.TimestampType()),
        T.StructField("deathtime", T.TimestampType()),
        T.StructField("adm_to_icu_period", T.DoubleType()),
        T.StructField("icu_los", T.DoubleType()),
        T.StructField("charttime_to_icu_period", T.DoubleType()),
        T.StructField("chartinterval", T.IntegerType()),
        T.StructField("imminent_adm_label", T.IntegerType()),
        T.StructField("prolonged_stay_label", T.IntegerType()),
    ]
)

PREDICTIONS_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("target", T.IntegerType()),
        T.StructField("prob", T.DoubleType()),
        T.StructField("pred", T.IntegerType()),
        T.StructField("task", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("run", T.IntegerType()),
    ]
)

RUN_METRICS_SCHEMA = T.StructType(
    [
        T.StructField("run", T.IntegerType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("task", T.StringType()),
        T.StructField("model", T.StringType()),
    ]
)

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def scan_csv(spark: SparkSession, path: str, schema: T.StructType = NOTES_SCHEMA) -> DataFrame:
    """Typed CSV scan; quoted fields may span lines. Ingest once, then use Parquet:
    a file whose records span lines cannot be split."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def scan_csv_projected(
    spark: SparkSession, path: str, columns: Sequence[str], dates: Sequence[str] = (),
    schema: T.StructType = NOTES_SCHEMA,
) -> DataFrame:
    """Some columns of a CSV; the date columns are read as text and parsed."""
    fields = [
        T.StructField(f.name, T.StringType()) if f.name in dates else f for f in schema.fields
    ]
    raw = scan_csv(spark, path, T.StructType(fields)).select(*columns)
    return raw.withColumns({d: F.try_to_timestamp(F.col(d)) for d in dates})


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.options(header="true", quote='"', escape='"').csv(path)


def sink_predictions(preds: DataFrame, path: str) -> None:
    """Parquet, partitioned by task and model, so that one model reads only its files.

    A repeated write replaces the tasks and models that it holds, and no others.
    """
    _replace_partitions(preds, path)


def _replace_partitions(df: DataFrame, path: str) -> None:
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("task", "model").parquet(path)


def sink_seed_predictions(preds: DataFrame, path: str, task: str, model: str, run: int) -> None:
    """One folder per seed: a repeated run replaces its own rows only."""
    preds.select("row_id", "target", "prob", "pred").write.mode("overwrite").parquet(
        f"{path}/task={task}/model={model}/run={run}"
    )


def scan_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTIONS_SCHEMA).parquet(path).select(
        "task", "model", "run", "row_id", "target", "prob", "pred"
    )


def sink_run_metrics(metrics: DataFrame, path: str) -> None:
    """As for predictions: a repeated write replaces its tasks and models."""
    _replace_partitions(metrics, path)


def scan_run_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_METRICS_SCHEMA).parquet(path).select(
        "task", "model", "run", "metric", "value"
    )


def sink_metric_csv(table: DataFrame, path: str, label: str, decimals: int | None) -> None:
    """A label column, then the numbers with fixed decimals (or as they are)."""
    values = [c for c in table.columns if c != label]
    if decimals is not None:
        shown = [F.format_string(f"%.{decimals}f", F.col(c)).alias(c) for c in values]
    else:
        shown = [F.col(c).cast("string").alias(c) for c in values]
    table.select(label, *shown).write.option("header", "true").csv(path)


def scan_metric_csv(spark: SparkSession, path: str, label: str, values: Mapping[str, str]) -> DataFrame:
    fields = ", ".join([f"{label} string", *[f"{name} {kind}" for name, kind in values.items()]])
    return spark.read.schema(fields).option("header", "true").csv(path)


def sink_best_params(best: DataFrame, path: str) -> None:
    """A repeated search replaces what an earlier one found."""
    best.write.mode("overwrite").json(path)


def model_path(root: str, task: str, model: str, seed: int) -> str:
    return f"{root}/task={task}/model={model}/seed={seed}"


def save_model(fitted: PipelineModel, root: str, task: str, model: str, seed: int) -> None:
    """The pipeline holds the vocabulary, so a loaded model scores raw terms."""
    fitted.write().overwrite().save(model_path(root, task, model, seed))


def load_model(root: str, task: str, model: str, seed: int) -> PipelineModel:
    return PipelineModel.load(model_path(root, task, model, seed))


def scan_embeddings_text(spark: SparkSession, path: str) -> DataFrame:
    """Token and numbers per line, split at single spaces: (idx, token, vec).

    idx is the line number from zero. Lines are counted per read block; a window
    never sees more than one block.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.split(F.col("value"), " ").alias("parts"),
        F.lit(1).cast("long").alias("one"),
    )
    levels = {"lv1": F.col("file"), "lv2": F.col("block")}
    numbered = running_sums(lines, [], levels, ["at"], ["one"])
    numbers = F.filter(
        F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))), lambda x: x != ""
    )
    return numbered.select(
        (F.col("cum_one") - 1).alias("idx"),
        F.col("parts")[0].alias("token"),
        F.transform(numbers, lambda x: x.cast("double")).alias("vec"),
    )
