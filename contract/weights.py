"""TF-IDF, vocabularies, markers and parameter draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.config import MAX_FEATURES
from cohortlens.functions.scalar import round_metric
from cohortlens.operators import features, markers, splits, training
from cohortlens.plans.search import GBM_SPACE, sample_params
from contract.registry import query, rounded
from contract.tables import S, STOP, T1, T2, TERMS_SQL, WORDS, labelled_documents, table, talks, term_scores

MAIN = features.Weighting(features.MAIN.terms, binary=True, max_features=MAX_FEATURES)

_WS = r"regexp_extract_all({0}, '[^\s\x0b\x1c-\x1f\x85\p{{Z}}]+')"
# Terms per row: d(row_id, hadm_id, terms) for the two token rules.
_MAIN_DOCS = f"""{T1}, w AS (SELECT row_id, hadm_id, {WORDS.format('note')} AS w FROM t1),
  d AS (SELECT row_id, hadm_id, {TERMS_SQL.format('w')} AS terms FROM w)"""
_SEARCH_DOCS = f"{T1}, d AS (SELECT row_id, hadm_id, {_WS.format('note')} AS terms FROM t1)"
_DF = "df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(terms)) AS term FROM {0}) GROUP BY term {1})"
_TOP = "tv AS (SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS idx FROM (SELECT * FROM df ORDER BY df DESC, term LIMIT 60000))"
_ALL_TERMS = "tv AS (SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS idx FROM df)"


def _weights(binary: bool, fitted: str) -> str:
    """wt(row_id, term, idx, weight) from d and tv, with the row count of the fitted table."""
    tf = "1" if binary else "count(*)"
    return f"""tt AS (SELECT row_id, term, {tf} AS tf FROM (SELECT row_id, unnest(terms) AS term FROM d) GROUP BY row_id, term),
      rw AS (SELECT row_id, term, idx, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM {fitted})) / (1 + df)) + 1) AS x FROM tt JOIN tv USING (term)),
      wt AS (SELECT row_id, term, idx, x / sqrt(sum(x * x) OVER (PARTITION BY row_id)) AS weight FROM rw)"""


def _docs(spark, d):
    return talks(spark, d).withColumnRenamed("note", "processed_note")


@query("doc_frequency", f"WITH {_SEARCH_DOCS}, {_DF.format('d', 'HAVING count(*) >= 3')} SELECT term, df FROM df")
def doc_frequency(spark, d):
    return features.document_frequency(features.with_terms(_docs(spark, d), features.SEARCH), 3)


@query("topk_vocab", f"WITH {_MAIN_DOCS}, {_DF.format('d', '')} SELECT term, df FROM df ORDER BY df DESC, term LIMIT 60000")
def topk_vocab(spark, d):
    return features.top_terms(features.document_frequency(features.with_terms(_docs(spark, d), MAIN)), MAX_FEATURES)


@query("vocab_index", f"WITH {_MAIN_DOCS}, {_DF.format('d', '')}, {_TOP} SELECT term, df, idx FROM tv")
def vocab_index(spark, d):
    return features.vocabulary(features.with_terms(_docs(spark, d), MAIN), MAIN)


@query(
    "idf_smooth",
    f"""WITH {_SEARCH_DOCS}, {_DF.format('d', 'HAVING count(*) >= 3')}
    SELECT term, round(ln((1 + (SELECT count(*) FROM d)) / (1 + df)) + 1, 6) AS idf FROM df""",
)
def idf_smooth(spark, d):
    docs = features.with_terms(_docs(spark, d), features.SEARCH)
    n = docs.agg(F.count("*")).scalar()
    df = features.document_frequency(docs, 3)
    return rounded(df.select("term", features.idf_smooth(n, F.col("df")).alias("idf")), "idf")


_SPLIT = """g AS (SELECT hadm_id, row_number() OVER (ORDER BY md5('127:' || hadm_id), hadm_id) <= ceil(count(*) OVER () * 0.15::DOUBLE) AS test
    FROM (SELECT DISTINCT hadm_id FROM t1)),
  tr AS (SELECT d.* FROM d JOIN g USING (hadm_id) WHERE NOT test)"""


@query(
    "tfidf_a",
    f"""WITH {_MAIN_DOCS}, {_SPLIT}, {_DF.format('tr', '')}, {_TOP}, {_weights(True, 'tr')}
    SELECT row_id, term, idx, round(weight, 6) AS weight FROM wt""",
)
def tfidf_a(spark, d):
    sided = splits.split_group(_docs(spark, d), "hadm_id", seed=127)
    train = sided.filter(F.col("split") == "train")
    return rounded(features.tfidf(sided, MAIN, train), "weight")


@query(
    "tfidf_b",
    f"""WITH {_SEARCH_DOCS}, {_DF.format('d', 'HAVING count(*) >= 3')}, {_ALL_TERMS}, {_weights(False, 'd')}
    SELECT row_id, term, idx, round(weight, 6) AS weight FROM wt""",
)
def tfidf_b(spark, d):
    return rounded(features.tfidf(_docs(spark, d), features.SEARCH), "weight")


@query(
    "tfidf_c",
    f"""WITH {_SEARCH_DOCS}, {_DF.format('d', 'HAVING count(*) >= 3')}, {_ALL_TERMS}, {_weights(True, 'd')}
    SELECT row_id, term, idx, round(weight, 6) AS weight FROM wt""",
)
def tfidf_c(spark, d):
    return rounded(features.tfidf(_docs(spark, d), features.SEARCH_BINARY), "weight")


@query(
    "tfidf_fixed_vocab",
    f"""WITH {T1}, u AS (SELECT {_WS.format('note')} AS terms FROM t1 WHERE category = 'user'),
      vc AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx
        FROM (SELECT unnest(list_distinct(terms)) AS term FROM u) GROUP BY term HAVING count(*) >= 3),
      d AS (SELECT row_id, {_WS.format('note')} AS terms FROM t1 WHERE category = 'assistant'),
      {_DF.format('d', '')}, tv AS (SELECT term, df, idx FROM df JOIN vc USING (term)), {_weights(False, 'd')}
    SELECT row_id, term, idx, round(weight, 6) AS weight FROM wt""",
)
def tfidf_fixed_vocab(spark, d):
    docs = _docs(spark, d)
    users = features.with_terms(docs.filter(F.col("category") == "user"), features.SEARCH)
    vocab = features.vocabulary(users, features.SEARCH).select("term", "idx")
    scored = docs.filter(F.col("category") == "assistant")
    return rounded(features.tfidf_fixed_vocab(scored, vocab, features.SEARCH), "weight")


@query(
    "l2_normalize",
    f"""WITH {T1}, x AS (SELECT row_id, term, count(*) AS c FROM (SELECT row_id, unnest({WORDS.format('note')}) AS term FROM t1) GROUP BY ALL)
    SELECT row_id, term, round(c / sqrt(sum(c * c) OVER (PARTITION BY row_id)), 6) AS weight FROM x""",
)
def l2_normalize(spark, d):
    from cohortlens.functions.text import word_tokens

    counted = features.term_counts(talks(spark, d).withColumn("terms", word_tokens(F.col("note"))), binary=False)
    return rounded(features.l2_normalize(counted.select("row_id", "term", F.col("tf").cast("double").alias("weight"))), "weight")


@query(
    "frequency_by_seed",
    f"""WITH {_MAIN_DOCS}, sd AS (SELECT unnest([127, 128, 129]) AS seed),
      g AS (SELECT seed, hadm_id, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || hadm_id), hadm_id)
          <= ceil(count(*) OVER (PARTITION BY seed) * 0.15::DOUBLE) AS test FROM (SELECT DISTINCT hadm_id FROM t1) CROSS JOIN sd),
      tr AS (SELECT seed, terms FROM d JOIN g USING (hadm_id) WHERE NOT test)
    SELECT seed, term, count(*) AS df FROM (SELECT seed, unnest(list_distinct(terms)) AS term FROM tr) GROUP BY 1, 2""",
)
def frequency_by_seed(spark, d):
    from cohortlens.plans.training import held_out, seed_cuts

    docs = features.with_terms(_docs(spark, d), MAIN)
    cuts = seed_cuts(docs, "hadm_id", [127, 128, 129])
    return features.frequency_by_seed(docs, {s: ~held_out("hadm_id", s, cut) for s, cut in cuts.items()})


@query(
    "class_weights",
    f"""WITH {T2} SELECT row_id, ia_label AS label,
      round(count(*) OVER () / (2 * count(*) OVER (PARTITION BY ia_label)), 6) AS weight FROM t2""",
)
def class_weights(spark, d):
    docs = labelled_documents(spark, d).select("row_id", F.col("ia_label").alias("label"))
    return rounded(training.class_weights(docs), "weight")


# --- markers -------------------------------------------------------------------------------------

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
_WORDS_OK = f"""regexp_matches(term, '^[a-z\\s]+$') AND len(list_filter(regexp_extract_all(term, '\\S+'),
  lambda w: length(w) < 5 OR list_contains({_STOP}, w))) = 0"""
_WHOLE_OK = f"regexp_matches({{0}}, '^[a-z\\s]+$') AND length({{0}}) > 7 AND NOT list_contains({_STOP}, {{0}})"


@query("marker_filter_words", f"WITH {S} SELECT term FROM s WHERE {_WORDS_OK}")
def marker_filter_words(spark, d):
    return term_scores(spark, d).filter(markers.marker_filter_words(F.col("term"), STOP)).select("term")


@query("marker_filter_whole", f"WITH {S} SELECT term FROM s WHERE {_WHOLE_OK.format('term')}")
def marker_filter_whole(spark, d):
    return term_scores(spark, d).filter(markers.marker_filter_whole(F.col("term"), STOP)).select("term")


# Adding two keeps the sum of all scores away from zero.
@query("feature_importance", f"WITH {S} SELECT idx, term, round((score + 2) / sum(score + 2) OVER () * 1000, 6) AS score FROM s")
def feature_importance(spark, d):
    scores = term_scores(spark, d).select("idx", "term", (F.col("score") + 2).alias("score"))
    shares = markers.feature_importance(scores)
    return rounded(shares.withColumn("score", F.col("score") * 1000), "score")


@query(
    "top_markers",
    f"""WITH {S}, k AS (SELECT term, (score + 2) / sum(score + 2) OVER () AS score FROM s WHERE {_WORDS_OK}),
      r AS (SELECT *, row_number() OVER (ORDER BY score, term) AS a, row_number() OVER (ORDER BY score DESC, term DESC) AS b FROM k)
    SELECT 'pos' AS side, term, round(score * 1000, 6) AS score FROM r WHERE a <= 50
    UNION ALL SELECT 'neg', term, round(-score * 1000, 6) FROM r WHERE b <= 50""",
)
def top_markers(spark, d):
    scores = term_scores(spark, d).select("idx", "term", (F.col("score") + 2).alias("score"))
    return rounded(markers.top_markers(scores, 50, STOP).withColumn("score", F.col("score") * 1000), "score")


@query(
    "term_cloud_weights",
    f"""WITH {S}, k AS (SELECT lower(term) AS term, arg_max(score, idx) AS score FROM s WHERE {_WHOLE_OK.format('lower(term)')} GROUP BY 1),
      r AS (SELECT *, row_number() OVER (ORDER BY score DESC, term) AS a, row_number() OVER (ORDER BY 1 - score DESC, term) AS b FROM k)
    SELECT 'pos' AS side, term, round(score, 6) + 0 AS weight FROM r WHERE a <= 50
    UNION ALL SELECT 'neg', term, round(1 - score, 6) + 0 FROM r WHERE b <= 50""",
)
def term_cloud_weights(spark, d):
    return rounded(markers.term_cloud_weights(term_scores(spark, d), STOP, 50), "weight")


# --- parameter draws: one set per order -----------------------------------------------------------


def _u(name: str) -> str:
    return f"('0x' || substr(md5('643:' || o_orderkey || ':{name}'), 1, 8))::BIGINT / 4294967296"


def _int(name: str, low: int, high: int) -> str:
    return f"({low} + floor({_u(name)} * {high - low}))::INTEGER AS {name}"


def _real(name: str, low: float, width: float) -> str:
    return f"round({low}::DOUBLE + {_u(name)} * {width}::DOUBLE, 6) AS {name}"


@query(
    "param_sampling",
    f"""SELECT o_orderkey, {_int('num_leaves', 30, 60)}, {_real('bagging_fraction', 0.2, 0.7)}, {_real('learning_rate', 0.1, 0.9)},
      {_int('min_data_in_leaf', 2, 20)}, {_int('max_bin', 3, 20)},
      CASE WHEN {_u('boosting')} < 0.5 THEN 'gbdt' ELSE 'dart' END AS boosting, {_int('bagging_freq', 3, 31)},
      {_int('max_depth', 0, 11)}, {_real('feature_fraction', 0.2, 0.7)}, {_real('lambda_l1', 0, 10)},
      {_int('num_iterations', 100, 200)} FROM orders""",
)
def param_sampling(spark, d):
    draws = sample_params(table(spark, d, "orders"), GBM_SPACE, 643, draw="o_orderkey")
    return rounded(draws, "bagging_fraction", "learning_rate", "feature_fraction", "lambda_l1")
