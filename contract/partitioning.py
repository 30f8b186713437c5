"""Splits over one and many seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.config import seeds
from cohortlens.operators import cohort, splits
from contract.registry import query, rounded
from contract.tables import N, T1, T2, labelled_documents, notes, talks

SEEDS = seeds(100)


def _ranked(cte: str, source: str, key: str, seed: int, name: str = "g") -> str:
    return f"""{cte}, {name} AS (SELECT {key}, row_number() OVER (ORDER BY md5('{seed}:' || {key}), {key}) AS rk,
      count(*) OVER () AS c FROM (SELECT DISTINCT {key} FROM {source}))"""


@query(
    "split_group",
    f"""WITH {_ranked(N, 'n', 'hadm_id', 127)} SELECT row_id, hadm_id,
      CASE WHEN rk <= ceil(c * 0.15::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM n JOIN g USING (hadm_id)""",
)
def split_group(spark, d):
    return splits.split_group(notes(spark, d).select("row_id", "hadm_id"), "hadm_id", seed=127)


# The sum of both shares in floating point, which is what rounds up.
_HELD = "ceil(c * (0.2::DOUBLE + 0.1::DOUBLE))"
_THREE = f"""CASE WHEN rk <= ceil({_HELD} * 0.33::DOUBLE) THEN 'test'
  WHEN rk <= {_HELD} THEN 'val' ELSE 'train' END"""


@query(
    "split_group_three",
    f"WITH {_ranked(N, 'n', 'hadm_id', 7)} SELECT row_id, hadm_id, {_THREE} AS split FROM n JOIN g USING (hadm_id)",
)
def split_group_three(spark, d):
    return splits.split_group_three(notes(spark, d).select("row_id", "hadm_id"), "hadm_id", 0.2, 0.1, seed=7)


@query("split_three", f"WITH {_ranked(T1, 't1', 'row_id', 7)} SELECT row_id, {_THREE} AS split FROM g")
def split_three(spark, d):
    return splits.split_three(talks(spark, d).select("row_id"), 0.2, 0.1, seed=7)


@query(
    "split_three_sample",
    f"""WITH {_ranked(T1, 't1', 'row_id', 7)} SELECT row_id, {_THREE} AS split,
      rk > {_HELD} AND rk <= {_HELD} + ceil((c - {_HELD}) * 0.2::DOUBLE) AS is_sample FROM g""",
)
def split_three_sample(spark, d):
    return splits.split_three_sample(talks(spark, d).select("row_id"), 0.2, 0.1, 0.2, seed=7)


@query(
    "split_two",
    f"WITH {_ranked(T1, 't1', 'row_id', 11)} SELECT row_id, CASE WHEN rk <= ceil(c * 0.15::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM g",
)
def split_two(spark, d):
    return splits.split_two(talks(spark, d).select("row_id"), "val", seed=11)


@query("split_bool", f"WITH {_ranked(T1, 't1', 'row_id', 11)} SELECT row_id, rk <= ceil(c * 0.15::DOUBLE) AS is_valid FROM g")
def split_bool(spark, d):
    return splits.split_bool(talks(spark, d).select("row_id"), seed=11)


@query(
    "split_check",
    f"""WITH {_ranked(N, 'n', 'hadm_id', 127)}, r AS (SELECT hadm_id, rk <= ceil(c * 0.15::DOUBLE) AS t FROM n JOIN g USING (hadm_id)),
      s AS (SELECT avg(CASE WHEN t THEN 1.0 ELSE 0.0 END) AS test FROM r)
    SELECT 'share:train' AS "check", abs(1 - test - 0.85) <= 0.1 + 0.1 * 0.85 AS passed FROM s
    UNION ALL SELECT 'share:test', abs(test - 0.15) <= 0.1 + 0.1 * 0.15 FROM s
    UNION ALL SELECT 'disjoint', NOT EXISTS (SELECT hadm_id FROM r GROUP BY 1 HAVING count(DISTINCT t) > 1)""",
)
def split_check(spark, d):
    sided = splits.split_group(notes(spark, d).select("row_id", "hadm_id"), "hadm_id", seed=127)
    return splits.split_check(sided, {"train": 0.85, "test": 0.15}, "hadm_id")


_MANY = f"""{N}, sd AS (SELECT range::INTEGER AS seed FROM range(127, 227)),
  ids AS (SELECT DISTINCT hadm_id FROM n),
  r AS (SELECT seed, hadm_id, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || hadm_id), hadm_id) AS rk,
      count(*) OVER (PARTITION BY seed) AS c FROM ids CROSS JOIN sd),
  m AS (SELECT seed, hadm_id, CASE WHEN rk <= ceil(c * 0.15::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r)"""


@query("split_many_seeds", f"WITH {_MANY} SELECT * FROM m")
def split_many_seeds(spark, d):
    return splits.split_many_seeds(notes(spark, d), "hadm_id", SEEDS)


@query(
    "agg_prevalence_over_seeds",
    f"""WITH {_MANY}, e AS (SELECT seed, avg(CASE WHEN prolonged_stay_label = 1 THEN 1.0::DOUBLE ELSE 0 END) AS pv
        FROM n JOIN m USING (hadm_id) WHERE split = 'test' GROUP BY seed)
    SELECT count(*) AS n_seeds, round(avg(pv), 6) AS mean, round(stddev_pop(pv), 6) AS std FROM e""",
)
def agg_prevalence_over_seeds(spark, d):
    return rounded(
        splits.prevalence_over_seeds(notes(spark, d), "hadm_id", "prolonged_stay_label", SEEDS), "mean", "std"
    )


@query(
    "stratified_holdout",
    f"""WITH {T2} SELECT row_id, ia_label, row_number() OVER (PARTITION BY ia_label ORDER BY md5('127:' || row_id), row_id)
      <= ceil(count(*) OVER (PARTITION BY ia_label) * 0.15::DOUBLE) AS is_valid FROM t2""",
)
def stratified_holdout(spark, d):
    docs = labelled_documents(spark, d).select("row_id", "ia_label")
    return splits.stratified_holdout(docs, "ia_label", seed=127)
