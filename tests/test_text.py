from pyspark.sql import functions as F

from cohortlens.functions import scalar, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("o")).first()["o"]


def test_note_concat_is_null_when_a_part_is(spark):
    df = spark.createDataFrame([("a", None, "c"), ("a", "b", "c")], "a string, b string, c string")
    got = [r[0] for r in df.select(text.note_concat(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [None, "a\nb\nc"]


def test_ethnicity_order(spark):
    assert one(spark, "White Hispanic", text.group_ethnicity) == "white"
    assert one(spark, "HISPANIC OR LATINO", text.group_ethnicity) == "hispanic"
    assert one(spark, "OTHER", text.group_ethnicity) == "unknown"


def test_tokenizers(spark):
    assert one(spark, "Été a l'un x_1", text.word_tokens) == ["été", "un", "x_1"]
    assert one(spark, "  A  b  c\x1d", text.whitespace_tokens) == ["A", "b", "c"]
    assert one(spark, "", text.whitespace_tokens) == []
    assert one(spark, "well-known, U.S. (x)", lambda c: text.tokenize_note(c)) == "well-known , U.S . ( x )"
    assert one(spark, "a b", lambda c: text.tokenize_note(c, text.whitespace_tokens)) == "a b"


def test_ngrams(spark):
    grams = lambda c: text.ngrams_1_2(text.whitespace_tokens(c))
    assert one(spark, "a b c", grams) == ["a", "b", "c", "a b", "b c"]
    assert one(spark, "a", grams) == ["a"]
    assert one(spark, "", grams) == []


def test_interval_bucket(spark):
    df = spark.createDataFrame([(-30 * 3600.0,), (-6 * 3600.0,), (0.0,)], "s double")
    at = lambda **o: [r[0] for r in df.select(scalar.interval_bucket(F.col("s"), F.lit(0.0), 12, **o)).collect()]
    assert at() == [-1.0, 0.0, 0.0]
    six = [r[0] for r in df.select(scalar.interval_bucket(F.col("s"), F.lit(0.0), 6, strict=True)).collect()]
    assert six == [-1.25, -0.25, 0.0]


def test_rounding_and_clip(spark):
    row = spark.createDataFrame([(2.5, 120.0, None)], "a double, b double, c double").select(
        scalar.round_metric(F.col("a"), 0), scalar.clip_upper(F.col("b"), 100.0), scalar.clip_upper(F.col("c"), 100.0)
    ).first()
    assert tuple(row) == (2.0, 100.0, None)


def test_relative_seconds_of_both_timestamp_types(spark):
    row = spark.sql(
        "select timestamp_ntz'2024-01-01 00:00:00.25' a, timestamp_ntz'2024-01-03 00:00:00' b,"
        " timestamp'2024-01-01 00:00:00.25' c, timestamp'2024-01-03 00:00:00' d"
    ).select(scalar.relative_seconds(F.col("a"), F.col("b")), scalar.relative_seconds(F.col("d"), F.col("c"))).first()
    assert tuple(row) == (-2 * 86400 + 0.25, 2 * 86400 - 0.25)
