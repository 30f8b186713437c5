import math

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import cohort, describe, reshape, vectors
from cohortlens.plans.preprocess import preprocess
from cohortlens.sources import tables

VECS = "idx long, token string, vec array<double>"


def table(spark):
    return spark.createDataFrame(
        [(0, "man", [0.0, 0.0]), (1, "woman", [0.0, 1.0]), (2, "king", [5.0, 0.0]), (3, "queen", [5.0, 1.0]), (4, "far", [90.0, 90.0])], VECS
    )


def test_analogy(spark):
    triples = spark.createDataFrame([("man", "king", "woman"), ("man", "man", "far")], "w1 string, w2 string, w3 string")
    got = {(r["w1"], r["w2"], r["w3"]): r["answer"] for r in vectors.analogy(triples, table(spark)).collect()}
    assert got[("man", "king", "woman")] == "man : king :: woman : queen"
    only = vectors.analogy(triples, table(spark), n=1).filter("w3 = 'far'").first()["answer"]
    assert only == vectors.NO_NEIGHBOURS


def test_neighbours_and_lookup(spark):
    queries = spark.createDataFrame([("q", [5.0, 0.4])], "query string, vec array<double>")
    got = [(r["token"], r["distance"]) for r in vectors.nearest_neighbors(queries, table(spark), 2).orderBy("rank").collect()]
    assert got == [("king", 0.4), ("queen", 0.6)]
    near = vectors.approx_nearest_neighbors(queries, table(spark), 2).orderBy("rank").collect()
    assert [r["token"] for r in near] == ["king", "queen"]
    assert vectors.shape(table(spark)).first() == (5, 2)
    assert vectors.duplicate_tokens(table(spark)).count() == 0
    tokens = spark.createDataFrame([(0, "king"), (1, "unseen")], "pos int, token string")
    rows = {r["token"]: r for r in vectors.custom_matrix(tokens, table(spark)).collect()}
    assert rows["king"]["vec"] == [5.0, 0.0] and not rows["unseen"]["is_pretrained"]
    assert len(rows["unseen"]["vec"]) == 2 and all(abs(x) <= math.sqrt(2) for x in rows["unseen"]["vec"])


def test_embeddings_file(spark, tmp_path):
    path = tmp_path / "vec.txt"
    path.write_text("".join(f"t{i} {i}.5 -1e-3 \n" for i in range(50)))
    got = tables.scan_embeddings_text(spark, str(path)).orderBy("idx").collect()
    assert [(r["idx"], r["token"], r["vec"]) for r in got] == [(i, f"t{i}", [i + 0.5, -0.001]) for i in range(50)]


def test_csv_round_trip_keeps_lines_and_quotes(spark, tmp_path):
    rows = [(1, 'a "b"\nc, d', "2024-01-02 03:04:05"), (2, "x\\", None)]
    schema = "row_id long, text string, charttime string"
    df = spark.createDataFrame(rows, schema)
    tables.sink_csv(df, str(tmp_path / "c"))
    back = tables.scan_csv(spark, str(tmp_path / "c"), df.schema)
    assert sorted(map(tuple, back.collect())) == rows
    dated = tables.scan_csv_projected(spark, str(tmp_path / "c"), ["row_id", "charttime"], ["charttime"], df.schema)
    assert dict(dated.dtypes) == {"row_id": "bigint", "charttime": "timestamp"}
    assert dated.filter("row_id = 1").select(F.year("charttime")).first()[0] == 2024


def test_metric_csv_formats(spark, tmp_path):
    df = spark.createDataFrame([("lr", 12.345, 0.5)], "model string, ppv double, npv double")
    tables.sink_metric_csv(df, str(tmp_path / "m"), "model", 1)
    assert spark.read.text(str(tmp_path / "m")).filter("value like 'lr%'").first()[0] == "lr,12.3,0.5"
    tables.sink_metric_csv(df, str(tmp_path / "n"), "model", None)
    back = tables.scan_metric_csv(spark, str(tmp_path / "n"), "model", {"ppv": "double", "npv": "double"})
    assert back.first() == ("lr", 12.345, 0.5)


def test_preprocess(spark):
    rows = [("Nursing", "Report", "Pt ok.", "WHITE - X")] * 2 + [("Nursing", None, "x", "ASIAN")]
    raw = spark.createDataFrame(rows, "category string, description string, text string, ethnicity string")
    out = {r["ethnicity"]: r for r in preprocess(raw).collect()}
    assert out["white"]["note"] == "Nursing\nReport\nPt ok."
    assert out["white"]["processed_note"] == "Nursing Report Pt ok ."
    assert out["asian"]["note"] is None and len(out) == 2
    scrubbed = preprocess(raw, scrub=True).filter("ethnicity = 'white'").first()["processed_note"]
    assert scrubbed == "Nursing Report patient ok ."


def test_descriptive_edges(spark):
    flat = spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double")
    bins = {r["bin"]: r["n"] for r in describe.histogram(flat, "v", 4).collect()}
    assert bins == {0: 0, 1: 0, 2: 2, 3: 0}
    groups = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 4.0)], "k string, v double")
    filled = {(r["k"], r["bin"]): r["n"] for r in describe.grouped_histogram(groups, "k", "v", 4).collect()}
    assert filled == {("a", 2): 2, ("b", 0): 1, ("b", 3): 1}
    spread = spark.createDataFrame([(0.0,), (1.0,), (10.0,)], "v double")
    assert {r["bin"]: r["n"] for r in describe.histogram(spread, "v", 2).collect()} == {0: 2, 1: 1}
    stats = {r["stat"]: r["value"] for r in describe.describe(spread, ["v"]).collect()}
    assert stats["50%"] == 1.0 and stats["count"] == 3.0 and stats["25%"] == 0.5


def test_cohorts_and_labels(spark):
    assert cohort.day_range(1, -20) == (-20, -1) and cohort.day_range(-20, -1) == (-20, -1)
    df = spark.createDataFrame([(-1, 5), (1, 7), (0, 6)], "imminent_adm_label int, n int")
    got = [r["imminent_adm_label"] for r in cohort.decode_label(df, "imminent_adm_label").collect()]
    assert got == ["Imminent Admission", "Delayed Admission", "Unused"]
    days = spark.createDataFrame([(0,), (15,), (16,)], "chartinterval int")
    assert [r["days"] for r in cohort.decode_interval(days).collect()] == ["-1 ≤ t ≤ 0", "t ≤ -15", None]
    words = spark.createDataFrame([("a", 0.125), ("b", 0.5), ("c", -1.0)], "term string, score double")
    got = {(r["side"], r["term"]): r["score"] for r in reshape.top_words_pos_neg(words, 1).collect()}
    assert got == {("pos", "b"): 0.5, ("neg", "c"): -1.0}
