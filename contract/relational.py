"""Cohorts, descriptive statistics, sorts, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.config import INTERVAL_NAMES
from cohortlens.functions import scalar
from cohortlens.operators import cohort, describe, reshape
from contract.registry import query, rounded
from contract.tables import N, S, T1, notes, table, talks, term_scores

# --- projections, filters, predicates ---------------------------------------------------


@query("cohort_ia", f"WITH {N} SELECT row_id, hadm_id, processed_note, imminent_adm_label FROM n WHERE imminent_adm_label <> -1")
def cohort_ia(spark, d):
    return cohort.cohort_ia(notes(spark, d))


@query("cohort_ps", f"WITH {N} SELECT row_id, hadm_id, processed_note, prolonged_stay_label FROM n WHERE chartinterval <> 0")
def cohort_ps(spark, d):
    return cohort.cohort_ps(notes(spark, d))


@query("cohort_ps_unfiltered", f"WITH {N} SELECT row_id, hadm_id, processed_note, prolonged_stay_label FROM n")
def cohort_ps_unfiltered(spark, d):
    return cohort.cohort_ps_unfiltered(notes(spark, d))


@query(
    "cohort_with_time",
    f"""WITH {N} SELECT row_id, hadm_id, processed_note, prolonged_stay_label,
    round(relative_seconds, 6) + 0 AS relative_seconds FROM n WHERE chartinterval <> 0""",
)
def cohort_with_time(spark, d):
    return rounded(cohort.cohort_with_time(notes(spark, d), "ps").drop("relative_charttime"), "relative_seconds")


@query("relative_time", f"WITH {N} SELECT row_id, round(relative_seconds, 6) + 0 AS relative_seconds FROM n")
def relative_time(spark, d):
    return rounded(cohort.with_relative_time(notes(spark, d)).select("row_id", "relative_seconds"), "relative_seconds")


@query(
    "split_filter",
    f"""WITH {N}, g AS (SELECT hadm_id, row_number() OVER (ORDER BY md5('127:' || hadm_id), hadm_id) AS rk,
      count(*) OVER () AS c FROM (SELECT DISTINCT hadm_id FROM n))
    SELECT row_id, hadm_id FROM n JOIN g USING (hadm_id) WHERE rk <= ceil(c * 0.15::DOUBLE)""",
)
def split_filter(spark, d):
    from cohortlens.operators.splits import split_group

    sided = split_group(notes(spark, d).select("row_id", "hadm_id"), "hadm_id", seed=127)
    return cohort.split_filter(sided, "test").select("row_id", "hadm_id")


@query(
    "time_range_filter",
    f"""WITH {N} SELECT row_id, chartinterval FROM n
    WHERE relative_seconds > -20 * 86400 AND relative_seconds < -1 * 86400""",
)
def time_range_filter(spark, d):
    timed = cohort.with_relative_time(notes(spark, d))
    return cohort.time_range_filter(timed, -1, 20).select("row_id", "chartinterval")


@query("clip_upper", f"WITH {N} SELECT row_id, least(admission_age, 100) AS admission_age FROM n")
def clip_upper(spark, d):
    return notes(spark, d).select("row_id", scalar.clip_upper(F.col("admission_age"), 100.0).alias("admission_age"))


@query("is_not_null_flag", f"WITH {N} SELECT row_id, deathtime IS NOT NULL AS died FROM n")
def is_not_null_flag(spark, d):
    return notes(spark, d).select("row_id", F.col("deathtime").isNotNull().alias("died"))


@query("threshold_predict", f"WITH {N} SELECT row_id, CAST(prob > 0.45::DOUBLE AS INTEGER) AS pred FROM n")
def threshold_predict(spark, d):
    return notes(spark, d).select("row_id", scalar.threshold_predict(F.col("prob"), 0.45).alias("pred"))


@query(
    "decode_label",
    f"""WITH {N} SELECT CASE imminent_adm_label WHEN -1 THEN 'Unused' WHEN 0 THEN 'Delayed Admission'
      ELSE 'Imminent Admission' END AS imminent_adm_label, count(*) AS n_notes FROM n GROUP BY 1""",
)
def decode_label(spark, d):
    counts = describe.group_count(notes(spark, d), "imminent_adm_label")
    return cohort.decode_label(counts, "imminent_adm_label")


_DAYS = "[" + ", ".join(f"'{name}'" for name in INTERVAL_NAMES) + "]"


@query("decode_interval", f"WITH {N} SELECT row_id, chartinterval, {_DAYS}[1 + chartinterval] AS days FROM n")
def decode_interval(spark, d):
    return cohort.decode_interval(notes(spark, d).select("row_id", "chartinterval"))


@query("drop_rename", f"WITH {T1} SELECT row_id, hadm_id, lower(note) AS processed_note FROM t1")
def drop_rename(spark, d):
    out = cohort.drop_rename(talks(spark, d), drop=["category"], rename={"note": "processed_note"})
    return out.withColumn("processed_note", F.lower("processed_note"))


@query(
    "scatter_scores",
    f"""WITH {N}, g AS (SELECT hadm_id, row_number() OVER (ORDER BY md5('643:' || hadm_id), hadm_id) AS rk,
      count(*) OVER () AS c FROM (SELECT DISTINCT hadm_id FROM n))
    SELECT row_id, CASE WHEN rk <= ceil(c * 0.25::DOUBLE) THEN prob ELSE -1 END AS prob FROM n JOIN g USING (hadm_id)""",
)
def scatter_scores(spark, d):
    from cohortlens.operators.splits import split_group

    sided = split_group(notes(spark, d).select("row_id", "hadm_id", "prob"), "hadm_id", 0.25, seed=643)
    return cohort.scatter_scores(sided.select("row_id"), cohort.split_filter(sided, "test"))


# --- joins --------------------------------------------------------------------------------


@query(
    "join_equi_inner",
    f"""WITH {N}, a AS (SELECT imminent_adm_label, count(*) AS n_notes FROM n GROUP BY 1),
      b AS (SELECT imminent_adm_label, count(DISTINCT hadm_id) AS n_hadm_id FROM n GROUP BY 1)
    SELECT * FROM a JOIN b USING (imminent_adm_label)""",
)
def join_equi_inner(spark, d):
    df = notes(spark, d)
    counts = describe.group_count(df, "imminent_adm_label")
    ids = describe.group_distinct(df, F.col("imminent_adm_label"), "imminent_adm_label", "hadm_id")
    return reshape.equi_inner(counts, ids, ["imminent_adm_label"])


@query(
    "semi_anti_disjoint",
    f"""WITH {N}, g AS (SELECT hadm_id, row_number() OVER (ORDER BY md5('127:' || hadm_id), hadm_id) AS rk,
        count(*) OVER () AS c FROM (SELECT DISTINCT hadm_id FROM n)),
      r AS (SELECT hadm_id, rk <= ceil(c * 0.15::DOUBLE) AS test FROM n JOIN g USING (hadm_id))
    SELECT count(*) AS n_shared FROM (SELECT DISTINCT hadm_id FROM r WHERE NOT test)
    WHERE hadm_id IN (SELECT hadm_id FROM r WHERE test)""",
)
def semi_anti_disjoint(spark, d):
    from cohortlens.operators.splits import split_group

    sided = split_group(notes(spark, d).select("hadm_id"), "hadm_id", seed=127)
    return reshape.shared_groups(sided, "hadm_id", "train", "test")


# --- aggregations -------------------------------------------------------------------------


@query("agg_row_count", "SELECT count(*) AS n_rows, (SELECT count(*) FROM (DESCRIBE documents)) AS n_columns FROM documents")
def agg_row_count(spark, d):
    return describe.row_count(table(spark, d, "documents"))


@query("agg_nunique", f"WITH {N} SELECT count(DISTINCT subject_id) AS n_subject_id, count(DISTINCT hadm_id) AS n_hadm_id FROM n")
def agg_nunique(spark, d):
    return describe.distinct_counts(notes(spark, d), ["subject_id", "hadm_id"])


@query(
    "agg_group_nunique",
    f"""WITH {N} SELECT 'ethnicity' AS key, CASE WHEN lower(ethnicity) LIKE '%white%' THEN 'white'
        WHEN lower(ethnicity) LIKE '%black%' THEN 'black' WHEN lower(ethnicity) LIKE '%hispanic%' THEN 'hispanic'
        WHEN lower(ethnicity) LIKE '%asian%' THEN 'asian' ELSE 'unknown' END AS value,
        count(DISTINCT subject_id) AS n_subject_id FROM n GROUP BY ALL
      UNION ALL SELECT 'gender', gender, count(DISTINCT subject_id) FROM n GROUP BY ALL
      UNION ALL SELECT 'admission_type', admission_type, count(DISTINCT subject_id) FROM n GROUP BY ALL
      UNION ALL SELECT 'died', CAST(deathtime IS NOT NULL AS VARCHAR), count(DISTINCT subject_id) FROM n GROUP BY ALL""",
)
def agg_group_nunique(spark, d):
    from cohortlens.functions.text import group_ethnicity

    df = notes(spark, d)
    keys = {
        "ethnicity": group_ethnicity(F.col("ethnicity")),
        "gender": F.col("gender"),
        "admission_type": F.col("admission_type"),
        "died": F.col("deathtime").isNotNull().cast("string"),
    }
    parts = [
        describe.group_distinct(df, key, "value", "subject_id").select(F.lit(name).alias("key"), "value", "n_subject_id")
        for name, key in keys.items()
    ]
    return reshape.union_splits(*parts)


@query("agg_group_count", f"WITH {N} SELECT category, count(*) AS n_notes FROM n GROUP BY 1")
def agg_group_count(spark, d):
    return describe.group_count(notes(spark, d), "category")


@query(
    "agg_filtered_group_count",
    f"""WITH {N} SELECT category, count(*) FILTER (WHERE imminent_adm_label = 1) AS imminent,
      count(*) FILTER (WHERE imminent_adm_label = 0) AS delayed,
      count(*) FILTER (WHERE prolonged_stay_label = 1) AS prolonged,
      count(*) FILTER (WHERE prolonged_stay_label = 0) AS short FROM n GROUP BY 1""",
)
def agg_filtered_group_count(spark, d):
    return describe.filtered_group_counts(
        notes(spark, d),
        "category",
        {
            "imminent": F.col("imminent_adm_label") == 1,
            "delayed": F.col("imminent_adm_label") == 0,
            "prolonged": F.col("prolonged_stay_label") == 1,
            "short": F.col("prolonged_stay_label") == 0,
        },
    )


@query(
    "agg_two_key_count",
    f"""WITH {N} SELECT category, chartinterval, count(*) AS n_notes,
      CAST(sum(count(*)) OVER (PARTITION BY category) AS BIGINT) AS n_total FROM n GROUP BY 1, 2""",
)
def agg_two_key_count(spark, d):
    return describe.two_key_counts(notes(spark, d), "category", "chartinterval")


@query("agg_first_per_group", f"WITH {N} SELECT subject_id, arg_min(admission_age, row_id) AS admission_age FROM n GROUP BY 1")
def agg_first_per_group(spark, d):
    return describe.first_per_group(notes(spark, d), "subject_id", "admission_age", "row_id")


@query(
    "agg_mean_quartiles",
    f"""WITH {N}, a AS (SELECT least(admission_age, 100) AS a FROM n)
    SELECT round(avg(a), 6) AS mean, round(median(a), 6) AS median, round(quantile_cont(a, 0.25), 6) AS q25,
      round(quantile_cont(a, 0.75), 6) AS q75 FROM a""",
)
def agg_mean_quartiles(spark, d):
    return rounded(describe.mean_quartiles(notes(spark, d), "admission_age", 100.0), "mean", "median", "q25", "q75")


_STATS = """SELECT '{0}' AS name, unnest(['count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) AS stat,
  round(unnest([count({0})::DOUBLE, avg({0}), stddev_samp({0}), min({0})::DOUBLE, quantile_cont({0}, 0.25),
    quantile_cont({0}, 0.5), quantile_cont({0}, 0.75), max({0})::DOUBLE]), 6) + 0 AS value FROM n"""


@query(
    "agg_describe",
    f"WITH {N} " + " UNION ALL ".join(_STATS.format(c) for c in ("adm_to_icu_period", "icu_los", "charttime_to_icu_period")),
)
def agg_describe(spark, d):
    return rounded(
        describe.describe(notes(spark, d), ["adm_to_icu_period", "icu_los", "charttime_to_icu_period"]), "value"
    )


@query(
    "agg_mean_group_size",
    f"WITH {N} SELECT round(avg(c), 6) AS mean_size FROM (SELECT count(*) AS c FROM n WHERE imminent_adm_label <> -1 GROUP BY hadm_id)",
)
def agg_mean_group_size(spark, d):
    return rounded(describe.mean_group_size(cohort.cohort_ia(notes(spark, d)), "hadm_id"), "mean_size")


@query(
    "agg_prevalence",
    f"""WITH {N} SELECT round(avg(CASE WHEN imminent_adm_label = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS prevalence
      FROM n WHERE imminent_adm_label <> -1""",
)
def agg_prevalence(spark, d):
    return rounded(describe.prevalence(cohort.cohort_ia(notes(spark, d)), "imminent_adm_label"), "prevalence")


@query(
    "agg_histogram",
    f"""WITH {N}, v AS (SELECT charttime_to_icu_period AS v FROM n), b AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
      c AS (SELECT least(floor((v - lo) * 80 / (hi - lo)), 79)::INTEGER AS bin, count(*) AS n FROM v, b GROUP BY 1)
    SELECT r.range::INTEGER AS bin, round(lo + r.range * ((hi - lo) / 80), 6) + 0 AS bin_low, coalesce(c.n, 0) AS n
    FROM range(80) r CROSS JOIN b LEFT JOIN c ON c.bin = r.range""",
)
def agg_histogram(spark, d):
    return rounded(describe.histogram(notes(spark, d), "charttime_to_icu_period", 80), "bin_low")


@query(
    "agg_histogram_by_group",
    f"""WITH {N}, b AS (SELECT category, min(charttime_to_icu_period) AS lo, max(charttime_to_icu_period) AS hi FROM n GROUP BY 1)
    SELECT category, least(floor((charttime_to_icu_period - lo) * 10 / (hi - lo)), 9)::INTEGER AS bin, count(*) AS n
    FROM n JOIN b USING (category) GROUP BY 1, 2""",
)
def agg_histogram_by_group(spark, d):
    return describe.grouped_histogram(notes(spark, d), "category", "charttime_to_icu_period", 10)


# --- sorts, limits ------------------------------------------------------------------------


@query("sort_by_score", f"WITH {S} SELECT term, round(score, 6) + 0 AS score FROM s ORDER BY s.score, term")
def sort_by_score(spark, d):
    return rounded(reshape.sort_by_score(term_scores(spark, d).select("term", "score")), "score")


@query(
    "head_tail_n",
    f"""WITH {S}, h AS (SELECT term, score, row_number() OVER (ORDER BY score, term) AS a,
      row_number() OVER (ORDER BY score DESC, term DESC) AS b FROM s)
    SELECT 'head' AS side, term, round(score, 6) + 0 AS score FROM h WHERE a <= 50
    UNION ALL SELECT 'tail', term, round(score, 6) + 0 FROM h WHERE b <= 50""",
)
def head_tail_n(spark, d):
    return rounded(reshape.head_tail_n(term_scores(spark, d).select("term", "score"), 50), "score")


@query(
    "top_words_pos_neg",
    f"""WITH {S}, h AS (SELECT term, score, row_number() OVER (ORDER BY score, term) AS a,
      row_number() OVER (ORDER BY score DESC, term DESC) AS b FROM s)
    SELECT 'neg' AS side, term, round_even(score, 2) + 0 AS score FROM h WHERE a <= 20
    UNION ALL SELECT 'pos', term, round_even(score, 2) + 0 FROM h WHERE b <= 20""",
)
def top_words_pos_neg(spark, d):
    return rounded(reshape.top_words_pos_neg(term_scores(spark, d), 20), "score")


@query("first_row", f"WITH {T1} SELECT * FROM t1 ORDER BY row_id LIMIT 1")
def first_row(spark, d):
    return reshape.first_row(talks(spark, d))


# --- sets and shapes ------------------------------------------------------------------------

_SIDES = f"""WITH {N}, g AS (SELECT hadm_id, row_number() OVER (ORDER BY md5('127:' || hadm_id), hadm_id) AS rk,
    count(*) OVER () AS c FROM (SELECT DISTINCT hadm_id FROM n)),
  r AS (SELECT row_id, hadm_id, CASE WHEN rk <= ceil(c * 0.15::DOUBLE) THEN 'test' ELSE 'train' END AS split
        FROM n JOIN g USING (hadm_id))"""


def _sides(spark, d):
    from cohortlens.operators.splits import split_group

    return split_group(notes(spark, d).select("row_id", "hadm_id"), "hadm_id", seed=127)


@query("distinct_groups", f"{_SIDES} SELECT DISTINCT hadm_id FROM r WHERE split = 'train'")
def distinct_groups(spark, d):
    return reshape.distinct_groups(_sides(spark, d), "hadm_id", "train")


@query("drop_duplicates", "SELECT DISTINCT text, lang FROM documents")
def drop_duplicates(spark, d):
    return reshape.drop_duplicates(table(spark, d, "documents").select("text", "lang"))


@query("union_splits", f"{_SIDES} SELECT row_id, hadm_id, split, CASE WHEN split = 'test' THEN 'yes' END AS held FROM r")
def union_splits(spark, d):
    sided = _sides(spark, d)
    train = cohort.split_filter(sided, "train")
    test = cohort.split_filter(sided, "test").withColumn("held", F.lit("yes"))
    return reshape.union_splits(train, test)


@query(
    "intersect_groups",
    f"WITH {N} SELECT DISTINCT hadm_id FROM n WHERE imminent_adm_label = 1 INTERSECT SELECT hadm_id FROM n WHERE deathtime IS NOT NULL",
)
def intersect_groups(spark, d):
    df = notes(spark, d)
    left = df.filter(F.col("imminent_adm_label") == 1)
    right = df.filter(F.col("deathtime").isNotNull())
    return reshape.intersect_groups(left, right, "hadm_id")


@query(
    "melt",
    f"""WITH {N}, c AS (SELECT CASE imminent_adm_label WHEN -1 THEN 'Unused' WHEN 0 THEN 'Delayed Admission'
        ELSE 'Imminent Admission' END AS imminent_adm_label, count(*) AS a, count(DISTINCT hadm_id) AS b FROM n GROUP BY 1)
    SELECT imminent_adm_label, '# Notes' AS legend, a AS counts FROM c
    UNION ALL SELECT imminent_adm_label, '# Admissions', b FROM c""",
)
def melt(spark, d):
    counts = reshape.count_and_distinct(notes(spark, d), "imminent_adm_label", "hadm_id")
    named = cohort.drop_rename(
        cohort.decode_label(counts, "imminent_adm_label"),
        rename={"n_notes": "# Notes", "n_hadm_id": "# Admissions"},
    )
    return reshape.melt(named, ["imminent_adm_label"], ["# Notes", "# Admissions"], "legend", "counts")
