"""The study's input tables, built from the given tables: in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.config import MODELS, THRESHOLDS
from cohortlens.functions.scalar import relative_seconds
from cohortlens.operators.evaluate import with_threshold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- N: notes with times and labels, from events ---------------------------------------

RAW_ETHNICITY = (
    "WHITE - RUSSIAN", "BLACK/AFRICAN", "HISPANIC OR LATINO", "ASIAN - INDIAN", "OTHER", "White Hispanic",
)
ADMISSION_TYPES = ("EMERGENCY", "ELECTIVE", "URGENT")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    base = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").alias("hadm_id"),
        (F.col("user_id") % 50).alias("subject_id"),
        F.col("event_type").alias("category"),
        F.col("ts").alias("charttime"),
        F.col("value").alias("admission_age"),
        (F.col("value") / 10.0).alias("icu_los"),
        F.concat_ws(" ", "event_type", "props").alias("processed_note"),
        k.alias("k"),
    )
    stays = base.groupBy("hadm_id").agg(F.max("charttime").alias("intime"), F.min("charttime").alias("admittime"))
    days = relative_seconds(F.col("intime"), F.col("charttime")) / 86400.0
    k = F.col("k")
    return base.join(stays, "hadm_id").select(
        "*",
        days.alias("charttime_to_icu_period"),
        (relative_seconds(F.col("intime"), F.col("admittime")) / 86400.0).alias("adm_to_icu_period"),
        F.least(F.floor(days), F.lit(15)).cast("int").alias("chartinterval"),
        (k % 3 - 1).alias("imminent_adm_label"),
        (k % 2).alias("prolonged_stay_label"),
        F.when(k < 10, F.col("charttime")).alias("deathtime"),
        _pick(RAW_ETHNICITY, k % 6).alias("ethnicity"),
        _pick(("M", "F"), k % 2).alias("gender"),
        _pick(ADMISSION_TYPES, k % 3).alias("admission_type"),
        (k / 101.0).alias("prob"),
    )


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


N = f"""
n0 AS (SELECT event_id AS row_id, user_id AS hadm_id, user_id % 50 AS subject_id, event_type AS category,
         ts AS charttime, value AS admission_age, value / 10 AS icu_los,
         event_type || ' ' || props AS processed_note,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
       FROM events),
ns AS (SELECT hadm_id, max(charttime) AS intime, min(charttime) AS admittime FROM n0 GROUP BY hadm_id),
n AS (SELECT n0.*, intime, admittime,
        (epoch_us(intime) - epoch_us(charttime))::DOUBLE / 86400e6 AS charttime_to_icu_period,
        (epoch_us(intime) - epoch_us(admittime))::DOUBLE / 86400e6 AS adm_to_icu_period,
        CAST(least(floor((epoch_us(intime) - epoch_us(charttime))::DOUBLE / 86400e6), 15) AS INTEGER) AS chartinterval,
        (epoch_us(charttime) - epoch_us(intime))::DOUBLE / 1e6 AS relative_seconds,
        k % 3 - 1 AS imminent_adm_label, k % 2 AS prolonged_stay_label,
        CASE WHEN k < 10 THEN charttime END AS deathtime,
        {_sql_list(RAW_ETHNICITY)}[1 + k % 6] AS ethnicity,
        ['M', 'F'][1 + k % 2] AS gender,
        {_sql_list(ADMISSION_TYPES)}[1 + k % 3] AS admission_type,
        k::DOUBLE / 101 AS prob
      FROM n0 JOIN ns USING (hadm_id))
"""

# --- T1: conversations as notes; T2: labelled documents ----------------------------------


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
        F.col("conv_id").alias("hadm_id"),
        F.col("role").alias("category"),
        F.col("text").alias("note"),
    )


T1 = """
t1 AS (SELECT conv_id * 1000 + turn AS row_id, conv_id AS hadm_id, role AS category, text AS note
       FROM conversations)
"""


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents")
        .join(table(spark, sf_dir, "labels"), "doc_id")
        .select(
            F.col("doc_id").alias("row_id"),
            F.col("source").alias("hadm_id"),
            F.col("text").alias("processed_note"),
            F.col("toxic").alias("ia_label"),
            F.col("quality").alias("ps_label"),
        )
    )


T2 = """
t2 AS (SELECT doc_id AS row_id, source AS hadm_id, text AS processed_note, toxic AS ia_label, quality AS ps_label
       FROM documents JOIN labels USING (doc_id))
"""

# --- P: predictions of four models for two tasks, from orders ----------------------------


def wide_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice") / 500000.0
    rf = (F.col("o_custkey") % 101) / 100.0
    gbm = (F.col("o_orderkey") % 97) / 96.0
    ia = (price + (F.col("o_custkey") % 100) / 100.0 > 1.0).cast("int")
    ps = (price * 0.75 + gbm * 0.25 > 0.5).cast("int")
    return (
        table(spark, sf_dir, "orders")
        .select(
            F.col("o_orderkey").alias("row_id"),
            (F.col("o_orderkey") % 10).cast("int").alias("run"),
            F.explode(F.array(F.struct(F.lit("ia").alias("task"), ia.alias("target")),
                              F.struct(F.lit("ps").alias("task"), ps.alias("target")))).alias("t"),
            price.alias("lr"),
            rf.alias("rf"),
            gbm.alias("gbm"),
            ((price + rf) / 2.0).alias("mlp"),
        )
        .select("t.task", "run", "row_id", "t.target", *MODELS)
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = wide_predictions(spark, sf_dir).unpivot(
        ["task", "run", "row_id", "target"], list(MODELS), "model", "prob"
    )
    limit = F.when(F.lit(False), F.lit(None).cast("double"))
    for task, by_model in THRESHOLDS.items():
        for model, value in by_model.items():
            limit = limit.when((F.col("task") == task) & (F.col("model") == model), F.lit(value))
    return with_threshold(long, limit).select("task", "model", "run", "row_id", "target", "prob", "pred")


P = """
pw0 AS (SELECT o_orderkey AS row_id, CAST(o_orderkey % 10 AS INTEGER) AS run, o_custkey,
          o_totalprice / 500000::DOUBLE AS lr, (o_custkey % 101)::DOUBLE / 100 AS rf,
          (o_orderkey % 97)::DOUBLE / 96 AS gbm
        FROM orders),
pw AS (SELECT 'ia' AS task, run, row_id,
         CASE WHEN lr + (o_custkey % 100)::DOUBLE / 100 > 1.0::DOUBLE THEN 1 ELSE 0 END AS target,
         lr, rf, gbm, (lr + rf) / 2 AS mlp FROM pw0
       UNION ALL
       SELECT 'ps', run, row_id,
         CASE WHEN lr * 0.75::DOUBLE + gbm * 0.25::DOUBLE > 0.5::DOUBLE THEN 1 ELSE 0 END,
         lr, rf, gbm, (lr + rf) / 2 FROM pw0),
th(task, model, threshold) AS (VALUES ('ia', 'lr', 0.45::DOUBLE), ('ia', 'rf', 0.27::DOUBLE),
  ('ia', 'gbm', 0.435::DOUBLE), ('ia', 'mlp', 0.2::DOUBLE), ('ps', 'lr', 0.39::DOUBLE),
  ('ps', 'rf', 0.36::DOUBLE), ('ps', 'gbm', 0.324::DOUBLE), ('ps', 'mlp', 0.27::DOUBLE)),
pl AS (SELECT task, 'lr' AS model, run, row_id, target, lr AS prob FROM pw
       UNION ALL SELECT task, 'rf', run, row_id, target, rf FROM pw
       UNION ALL SELECT task, 'gbm', run, row_id, target, gbm FROM pw
       UNION ALL SELECT task, 'mlp', run, row_id, target, mlp FROM pw),
p AS (SELECT task, model, run, row_id, target, prob, CAST(prob > threshold AS INTEGER) AS pred
      FROM pl JOIN th USING (task, model))
"""

# --- V: vectors, from embeddings -----------------------------------------------------------


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("idx"),
        F.concat(F.lit("w"), F.col("vec_id")).alias("token"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
    )


V = "v AS (SELECT vec_id AS idx, 'w' || vec_id AS token, embedding::DOUBLE[] AS vec FROM embeddings)"

# --- S: term scores, from the words of conversations -----------------------------------------

STOP = ("dans", "elle", "avec", "nicht", "einen", "oder", "thand", "which", "les elle", "trement")


def term_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.functions.text import ngrams_1_2, word_tokens
    from cohortlens.operators.features import with_index

    words = talks(spark, sf_dir).select(
        (F.col("category") == "user").cast("long").alias("u"),
        F.explode(F.array_distinct(ngrams_1_2(word_tokens(F.col("note"))))).alias("term"),
    )
    counts = words.groupBy("term").agg(F.sum("u").alias("u"), F.count("*").alias("df"))
    return with_index(
        counts.select("term", "df", ((2 * F.col("u") - F.col("df")) / (F.col("df") + 10.0)).alias("score"))
    )


WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{2,}}')"
TERMS_SQL = """list_concat({0}, list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"""

S = T1 + f""",
sw AS (SELECT category, {WORDS.format('note')} AS w FROM t1),
sx AS (SELECT category, unnest(list_distinct({TERMS_SQL.format('w')})) AS term FROM sw),
sc AS (SELECT term, count(*) AS df, count(*) FILTER (WHERE category = 'user') AS u FROM sx GROUP BY term),
s AS (SELECT term, df, (2 * u - df)::DOUBLE / (df + 10) AS score,
        row_number() OVER (ORDER BY term) - 1 AS idx FROM sc)
"""

# --- X: clinical-style notes with redaction spans, from orders --------------------------------

SPANS = (
    "Doctor Last Name {k}", "Last Name (un) ", "First Name8 (NamePattern2) ", "Doctor First Name {k}",
    "Initials (NamePattern4) ", "Name2 (NI) {k}", "Hospital1 {k}", "Company {k}", "University/College ",
    "Location (un) {k}", "Country {k}", "State {k}", "Street Address(2) {k}", "PO Box {k}",
    "Numeric Identifier {k}", "Pager number {k}", "Clip Number (Radiology) {k}", "Social Security Number {k}",
    "Medical Record Number {k}", "Age over 90 ", "Serial Number {k}", "Unit Number {k}", "MD Number(1) {k}",
    "Telephone/Fax (1) {k}", "Provider Number {k}", "Job Number {k}", "Dictator Info ", "Contact Info {k}",
    "Attending Info ", "{d}", "{k}-16", "a-b", "Month/Day (2) {k}", "Year (4 digits) ", "{y}", "Month {k}",
    "Holiday {k}", "Date Range (1) ", "{k}", "84", "7", " ", "un",
)
AGES = ("{a} year old", "{a} y.o.", "{a}yo", "{a} years-old", "{a} y/o", "{a} Years Old", "{a}-year-old", "{a} yr yr's yrs")
SEXES = ("M", "F", "man", "woman", "male", "gentlman", "gentleman", "m,", "female", "f")
PATIENTS = ("Pt", "pt.", "IN PT", "OUT PT", "ptosis", "OT PT", "Patient", "adapt")
CLOCKS = ("{h}:{m} AM", "{h}:{m} p.m.", "00:{m} am", ":{m} PM", "{h}: AM", "0:{m} PM", "{h}:{m}PM", "[**{h2}**] AM", "[**84**] p.m.")


def _fill(values, index, names) -> "F.Column":
    picked = _pick(values, index)
    for name, value in names.items():
        picked = F.replace(picked, F.lit("{" + name + "}"), value.cast("string"))
    return picked


def redacted_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    names = {
        "k": key % 1000,
        "d": F.concat_ws("-", F.year(day), F.month(day), F.day(day)),
        "y": F.year(day),
        "a": key % 100,
        "h": key % 27,
        "h2": F.lpad((key % 12).cast("string"), 2, "0"),
        "m": F.lpad((key % 75).cast("string"), 2, "0"),
    }
    fill = lambda values, index: _fill(values, index, names)
    span = lambda index: F.concat(F.lit("[**"), fill(SPANS, index % len(SPANS)), F.lit("**]"))
    text = F.concat(
        fill(PATIENTS, key % len(PATIENTS)), F.lit(" is a "), fill(AGES, (key / 3).cast("long") % len(AGES)), F.lit(" "),
        fill(SEXES, (key / 7).cast("long") % len(SEXES)), F.lit(" seen by "), span(key),
        F.lit("\nat "), span(key * 7 + 3), F.lit(", at "),
        fill(CLOCKS, (key / 5).cast("long") % len(CLOCKS)), F.lit(" for "), F.col("o_orderpriority"),
        F.lit(" [** **]"),
    )
    return table(spark, sf_dir, "orders").select(key.alias("row_id"), text.alias("note"))


def _fill_sql(values, index: str) -> str:
    out = f"{_sql_list(values)}[1 + {index}]"
    for name, value in {
        "k": "(o_orderkey % 1000)::VARCHAR",
        "d": "year(o_orderdate)::VARCHAR || '-' || month(o_orderdate)::VARCHAR || '-' || day(o_orderdate)::VARCHAR",
        "y": "year(o_orderdate)::VARCHAR",
        "a": "(o_orderkey % 100)::VARCHAR",
        "h": "(o_orderkey % 27)::VARCHAR",
        "h2": "lpad((o_orderkey % 12)::VARCHAR, 2, '0')",
        "m": "lpad((o_orderkey % 75)::VARCHAR, 2, '0')",
    }.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


X = f"""
x AS (SELECT o_orderkey AS row_id,
        {_fill_sql(PATIENTS, f'o_orderkey % {len(PATIENTS)}')} || ' is a ' ||
        {_fill_sql(AGES, f'(o_orderkey // 3) % {len(AGES)}')} || ' ' ||
        {_fill_sql(SEXES, f'(o_orderkey // 7) % {len(SEXES)}')} || ' seen by [**' ||
        {_fill_sql(SPANS, f'o_orderkey % {len(SPANS)}')} || '**]' || chr(10) || 'at [**' ||
        {_fill_sql(SPANS, f'(o_orderkey * 7 + 3) % {len(SPANS)}')} || '**], at ' ||
        {_fill_sql(CLOCKS, f'(o_orderkey // 5) % {len(CLOCKS)}')} || ' for ' || o_orderpriority || ' [** **]' AS note
      FROM orders)
"""
