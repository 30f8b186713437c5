import math

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortlens.operators import features, markers

DOCS = [
    (1, "the cat sat on the mat"),
    (2, "the dog sat sat sat down"),
    (3, "a cat and a dog and the dog"),
    (4, "nothing else matters here"),
    (5, ""),
]


def docs(spark):
    return spark.createDataFrame(DOCS, "row_id long, processed_note string")


def test_idf_golden(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "df int").select("df", features.idf_smooth(F.lit(3), F.col("df")).alias("v"))
    got = {r["df"]: r["v"] for r in df.collect()}
    assert got == pytest.approx({1: math.log(2) + 1, 2: math.log(4 / 3) + 1, 3: 1.0})


def test_binary_vocabulary_ranks_by_documents(spark):
    df = spark.createDataFrame([(1, "aa aa aa aa"), (2, "cc bb"), (3, "cc bb")], "row_id long, processed_note string")
    weighting = features.Weighting(features.text.whitespace_tokens, binary=True, max_features=2)
    got = features.vocabulary(features.with_terms(df, weighting), weighting).orderBy("idx").collect()
    assert [(r["term"], r["df"], r["idx"]) for r in got] == [("bb", 2, 0), ("cc", 2, 1)]


def test_unbounded_index_is_dense(spark):
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("term"))
    got = features.with_index(df).orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(500))
    assert [r["term"] for r in got] == sorted(r["term"] for r in got)


@pytest.mark.parametrize("binary", [True, False])
def test_weights_by_hand(spark, binary):
    weighting = features.Weighting(features.text.whitespace_tokens, binary=binary)
    got = {}
    for r in features.tfidf(docs(spark), weighting).collect():
        got.setdefault(r["row_id"], {})[r["term"]] = r["weight"]
    tokens = {i: t.split() for i, t in DOCS}
    df = lambda term: sum(term in t for t in tokens.values())
    for i, words in tokens.items():
        raw = {}
        for w in set(words):
            tf = 1 if binary else 1 + math.log(words.count(w))
            raw[w] = tf * (math.log((1 + len(DOCS)) / (1 + df(w))) + 1)
        norm = math.sqrt(sum(v * v for v in raw.values()))
        assert got.get(i, {}) == pytest.approx({w: v / norm for w, v in raw.items()})


def test_vectors_equal_the_relation(spark):
    weighting = features.Weighting(features.MAIN.terms, binary=True, max_features=12)
    with_terms = features.with_terms(docs(spark), weighting)
    vocab = features.vocabulary(with_terms, weighting)
    stages = features.vector_stages(vocab, len(DOCS))
    vectors = PipelineModel(stages).transform(with_terms)
    dense = {r["row_id"]: r["v"] for r in vectors.select("row_id", vector_to_array("features").alias("v")).collect()}
    weights = features.tfidf(docs(spark), weighting)
    long = features.assemble_vectors(docs(spark), weights, 12)
    sparse = {r["row_id"]: list(r["features"].toArray()) for r in long.select("row_id", "features").collect()}
    assert set(dense) == set(sparse) == {1, 2, 3, 4, 5}
    for i in dense:
        assert dense[i] == pytest.approx(sparse[i])
        assert sum(x * x for x in dense[i]) == pytest.approx(1.0 if any(dense[i]) else 0.0)


def test_frequency_by_seed_equals_single_counts(spark):
    with_terms = features.with_terms(docs(spark), features.SEARCH)
    flags = {1: F.col("row_id") > 1, 2: F.col("row_id") != 3}
    got = {(r["seed"], r["term"]): r["df"] for r in features.frequency_by_seed(with_terms, flags).collect()}
    for seed, flag in flags.items():
        want = {r["term"]: r["df"] for r in features.document_frequency(with_terms.filter(flag)).collect()}
        assert {t: d for (s, t), d in got.items() if s == seed} == want


def test_markers(spark):
    rows = [(0, "with pain", 0.5), (1, "chest pains", 1.0), (2, "abdomen", 3.0), (3, "x-ray image", 9.0), (4, "shortness", -2.0),
            (5, "Breathing", 0.25), (6, "breathing", 0.75)]
    scores = spark.createDataFrame(rows, "idx long, term string, score double")
    got = {(r["side"], r["term"]): r["score"] for r in markers.top_markers(scores, 2, ["abdomen"]).collect()}
    # Kept: chest pains, shortness, breathing; their scores sum to -0.25.
    assert got == {("pos", "chest pains"): -4.0, ("pos", "breathing"): -3.0, ("neg", "shortness"): -8.0, ("neg", "breathing"): 3.0}
    cloud = {(r["side"], r["term"]): r["weight"] for r in markers.term_cloud_weights(scores, ["abdomen"], 2).collect()}
    assert cloud[("pos", "breathing")] == 0.75 and cloud[("neg", "shortness")] == 3.0
    assert "which" in markers.default_stop_words()


def test_tasks_for_counting_terms_grow_with_the_terms(spark, monkeypatch):
    monkeypatch.setattr(features, "TERMS_PER_TASK", 100)
    docs = spark.range(40).selectExpr("id row_id", "split(repeat('a b c ', 5), ' ') terms")
    counts = features.term_counts(docs, binary=False)
    assert counts.rdd.getNumPartitions() == 1 + 40 * 16 // 100
    assert counts.filter("term = 'a' and tf = 5").count() == 40
    assert features.term_counts(docs.limit(0), binary=True).count() == 0
