"""Round trips through files in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.config import METRICS, model_order
from cohortlens.operators import cohort, evaluate, reshape, vectors as vector_ops
from cohortlens.plans.preprocess import preprocess
from cohortlens.sources import tables
from cohortlens.storage import scratch_path
from contract.evaluation import PM
from contract.registry import query, rounded
from contract.tables import N, P, V, notes, predictions, table, vectors

DOC_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("category", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ethnicity", T.StringType()),
    ]
)


def _documents(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("row_id"),
        F.col("lang").alias("category"),
        F.col("source").alias("description"),
        "text",
        F.when(F.col("doc_id") % 4 == 0, "WHITE - OTHER").otherwise("BLACK/CAPE").alias("ethnicity"),
    )


_DOCUMENTS = """SELECT doc_id AS row_id, lang AS category, source AS description, text,
  CASE WHEN doc_id % 4 = 0 THEN 'WHITE - OTHER' ELSE 'BLACK/CAPE' END AS ethnicity FROM documents"""


def _stored_documents(spark, d) -> str:
    path = scratch_path(spark, "documents_csv")
    tables.sink_csv(_documents(spark, d), path)
    return path


# CSV has no difference between an empty text and a missing one.
@query("scan_csv", f"SELECT row_id, category, description, nullif(text, '') AS text, ethnicity FROM ({_DOCUMENTS})")
def scan_csv(spark, d):
    return tables.scan_csv(spark, _stored_documents(spark, d), DOC_SCHEMA)


@query("sink_csv", f"SELECT row_id, md5(nullif(text, '')) AS digest, length(nullif(text, ''))::INTEGER AS n FROM ({_DOCUMENTS})")
def sink_csv(spark, d):
    back = tables.scan_csv(spark, _stored_documents(spark, d), DOC_SCHEMA)
    return back.select("row_id", F.md5("text").alias("digest"), F.length("text").alias("n"))


@query(
    "scan_csv_projected",
    f"""WITH {N} SELECT row_id, hadm_id, epoch_us(charttime) AS chart_us, epoch_us(intime) AS in_us, chartinterval FROM n""",
)
def scan_csv_projected(spark, d):
    path = scratch_path(spark, "notes_csv")
    columns = ["row_id", "hadm_id", "category", "charttime", "intime", "chartinterval"]
    stored = notes(spark, d).select(columns)
    shown = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    tables.sink_csv(stored.withColumns({c: F.date_format(c, shown) for c in ("charttime", "intime")}), path)
    schema = T.StructType([f for name in columns for f in tables.NOTES_SCHEMA.fields if f.name == name])
    wanted = ["row_id", "hadm_id", "charttime", "intime", "chartinterval"]
    back = tables.scan_csv_projected(spark, path, wanted, ["charttime", "intime"], schema)
    # Session-independent: microseconds since the epoch, as if the clock were UTC.
    zone = F.current_timezone()
    micros = lambda c: F.unix_micros(F.from_utc_timestamp(F.col(c), zone)).alias
    return back.select(
        "row_id", "hadm_id", micros("charttime")("chart_us"), micros("intime")("in_us"), "chartinterval"
    )


@query("sink_predictions", f"WITH {P} SELECT task, model, count(*) AS n, round(sum(prob), 6) AS prob, sum(pred)::BIGINT AS pred FROM p GROUP BY 1, 2")
def sink_predictions(spark, d):
    path = scratch_path(spark, "predictions")
    for _ in range(2):  # a repeated write leaves the same rows
        tables.sink_predictions(predictions(spark, d), path)
    back = tables.scan_predictions(spark, path)
    return rounded(
        back.groupBy("task", "model").agg(F.count("*").alias("n"), F.sum("prob").alias("prob"), F.sum("pred").alias("pred")), "prob"
    )


@query("scan_predictions", f"WITH {P} SELECT * FROM p WHERE task = 'ps' AND model = 'rf'")
def scan_predictions(spark, d):
    path = scratch_path(spark, "predictions")
    tables.sink_predictions(predictions(spark, d), path)
    return tables.scan_predictions(spark, path).filter((F.col("task") == "ps") & (F.col("model") == "rf"))


@query("sink_run_metrics", f"WITH {PM} SELECT task, model, run, metric, round(value, 6) AS value FROM m")
def sink_run_metrics(spark, d):
    path = scratch_path(spark, "run_metrics")
    tables.sink_run_metrics(evaluate.run_metrics(predictions(spark, d)), path)
    return rounded(tables.scan_run_metrics(spark, path), "value")


@query("scan_run_metrics", f"WITH {PM} SELECT run, metric, round(value, 6) AS value FROM m WHERE task = 'ia' AND model = 'lr'")
def scan_run_metrics(spark, d):
    path = scratch_path(spark, "run_metrics")
    tables.sink_run_metrics(evaluate.run_metrics(predictions(spark, d)), path)
    back = tables.scan_run_metrics(spark, path).filter((F.col("task") == "ia") & (F.col("model") == "lr"))
    return rounded(back.select("run", "metric", "value"), "value")


_AVG = f"""WITH {PM}, a AS (SELECT task, model, metric, round_even(avg(value), 3) * 100 AS value FROM m GROUP BY 1, 2, 3)"""


@query(
    "sink_metric_csv",
    f"""{_AVG} PIVOT (SELECT task || '|' || model AS model, metric, printf('%.1f', round(value, 1)) AS value FROM a)
      ON metric IN ('sensitivity', 'specificity', 'ppv', 'auroc', 'npv', 'f1') USING first(value) GROUP BY model""",
)
def sink_metric_csv(spark, d):
    wide = _wide_table(spark, d)
    path = scratch_path(spark, "metrics_csv")
    tables.sink_metric_csv(wide, path, "model", 1)
    return tables.scan_metric_csv(spark, path, "model", {m: "string" for m in METRICS})


def _wide_table(spark, d):
    averages = evaluate.avg_metrics(evaluate.run_metrics(predictions(spark, d)))
    averages = averages.withColumn("model", F.concat_ws("|", "task", "model"))
    return reshape.transpose_metrics(averages, ["model"], METRICS)


@query(
    "scan_metric_csv",
    f"""{_AVG} SELECT task, metric, model, round(value, 3) AS value FROM a
      QUALIFY row_number() OVER (PARTITION BY task, metric ORDER BY value DESC, list_position(['lr', 'rf', 'gbm', 'mlp'], model)) = 1""",
)
def scan_metric_csv(spark, d):
    averages = evaluate.avg_metrics(evaluate.run_metrics(predictions(spark, d)))
    best = evaluate.best_model_per_metric(averages, model_order())
    path = scratch_path(spark, "best_csv")
    # The label column keeps text; numbers are written with three decimals.
    labelled = best.select(F.concat_ws("|", "task", "metric", "model").alias("metric"), "value")
    tables.sink_metric_csv(labelled, path, "metric", 3)
    back = tables.scan_metric_csv(spark, path, "metric", {"value": "double"})
    parts = F.split("metric", r"\|")
    return back.select(parts[0].alias("task"), parts[1].alias("metric"), parts[2].alias("model"), "value")


@query("scan_embeddings_text", f"WITH {V} SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, token, len(vec)::INTEGER AS n, round(list_sum(vec), 6) + 0 AS total, 1::BIGINT AS copies FROM v")
def scan_embeddings_text(spark, d):
    source = vectors(spark, d)
    path = scratch_path(spark, "embeddings_text")
    source.orderBy("idx").select(
        F.concat_ws(" ", "token", F.array_join(F.transform("vec", lambda x: x.cast("string")), " "), F.lit("")).alias("value")
    ).write.text(path)
    back = vector_ops.unique_tokens(tables.scan_embeddings_text(spark, path))
    copies = back.groupBy("idx").agg(F.count("*").alias("copies"))
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return rounded(
        back.join(copies, "idx").select("idx", "token", F.size("vec").alias("n"), total.alias("total"), "copies"), "total"
    )


_W = r"[\p{L}\p{M}\p{N}_]+"
_TOKENS = _W + r"(?:[-''.]" + _W + r")*|[^\p{L}\p{M}\p{N}_\s\x0b\x1c-\x1f\x85\p{Z}]"


@query(
    "preprocess",
    f"""WITH x AS (SELECT DISTINCT lang AS category, lang || chr(10) || source || chr(10) || text AS note,
        CASE WHEN doc_id % 4 = 0 THEN 'white' ELSE 'black' END AS ethnicity FROM documents)
    SELECT category, ethnicity, note, array_to_string(regexp_extract_all(note, '{_TOKENS}'), ' ') AS processed_note FROM x""",
)
def preprocess_notes(spark, d):
    return preprocess(_documents(spark, d).drop("row_id"))
