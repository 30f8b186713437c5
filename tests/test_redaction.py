import pytest
from pyspark.sql import functions as F

from cohortlens.functions import redaction as R


def run(spark, fn, *texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", fn(F.col("t"), **options).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


CASES = {
    "redact_names": {
        "[**Doctor Last Name 12**]": "<docln>",
        "[**Last Name (un) **]": "<ln>",
        "[**First Name8 (NamePattern2) **]": "<fn>",
        "[**Doctor First Name 3**]": "<docfn>",
        "[**Initials (NamePattern4) **]": "<initial>",
        "[**Name2 (NI) **]": "<name>",
        "[**Hospital1 18**]": "[**Hospital1 18**]",
    },
    "redact_places": {
        "[**Hospital1 18**]": "<hosp>",
        "[**Location (un) 5**]": "<loc>",
        "[**PO Box 7**]": "<addr>",
        "[**University/College **]": "<work>",
        "[**State 5**]": "<state>",
    },
    "redact_identifiers": {
        "[**Age over 90 **]": "<age90>",
        "[**Telephone/Fax (1) 9**]": "<phno>",
        "[**Numeric Identifier 3**]": "<pagerno>",
        "[**Clip Number (Radiology) 4**]": "<radclip>",
    },
    "redact_dates": {
        "[**2151-7-16**]": "<date>",
        "[**7-16**]": "<mmdd>",
        "[**a-b**]": "<mmdd>",
        "[**2151**]": "<year>",
        "[**Holiday**]": "<hols>",
        "[**12345**]": "[**12345**]",
    },
    "redact_digits": {"[**84**]": "<2digit>", "[**123**]": "<3digit>", "[**7**]": "<1digit>", "[**x**]": "[**x**]"},
    "strip_leftover_spans": {"a [** **] b": "a  b", "a [**\n**] b": "a [**\n**] b"},
    "time_of_day_token": {
        "8:20 AM": "<forenoon>",
        "00:15 am": "<midnight>",
        "12:05 PM": "<afternoon>",
        "13:05 PM": "<afternoon>",
        "11:59 P.M": "<night>",
        "24:30 PM": "30",
        "8:75 AM": "75",
        "at 5:5 am, then 16:00 p.m. or 7:00 PM": "at <dawn>, then <dusk>. or <dusk>",
        ":  AM": ":  AM",
        ": AM": "<midnight>",
        "8: AM": "",
        "0:15 PM": "15",
    },
    "hour_token": {"[**84**] AM": "<hour>", "[**8**] AM": "[**8**] AM"},
    "norm_year_old": {"70 year old": "70 yo", "70-year-old": "70 yo", "70 y.o. man": "70 yo. man", "70yo": "70 yo"},
    "norm_years": {"yr yr yr Yr": "years years yr Yr", "yr's x": "years x"},
    "norm_patient": {"ptosis": "patient sis", "Pt, x": "patient  x", "IN PT": "patient ", "apt": "apt", "épt": "épt"},
    "norm_sex": {
        "M ": "male ", "M,": "M,", "woman ": "female ", "gentleman ": "gentleman ", "f": "female", "m m": "male male",
    },
}


@pytest.mark.parametrize("name", CASES)
def test_rules(spark, name):
    cases = CASES[name]
    assert run(spark, getattr(R, name), *cases) == list(cases.values())


def test_families_are_tried_in_order(spark):
    # An identifier wins over the slash of a date, a name over everything.
    got = run(spark, R.replace_redacted, "[**Telephone/Fax (1) 9**]", "[**Hospital Name 2001-1-1**]", "x[**5**]y[**Month 5**]z")
    assert got == ["<phno>", "<name>", "x<1digit>y<month>z"]


def test_text_around_spans_is_kept(spark):
    got = run(spark, R.replace_redacted, "[**7**]", "a[**7**]", "[**7**]b", "[**7**][**8**]", "none", None, "a [**\n7**]")
    assert got == ["<1digit>", "a<1digit>", "<1digit>b", "<1digit><1digit>", "none", None, "a [**\n7**]"]


def test_process_notes(spark):
    got = run(
        spark,
        R.process_notes,
        "Pt is a 70 year old M admitted [**2151-7-16**] at 8:20 AM [** **]",
        "[**84**] AM",
        "Yr yr",
    )
    assert got == ["patient is a 70 yo male admitted <date> at <forenoon> ", "<2digit> AM", "Yr years"]
    strict = run(spark, R.process_notes, "[**84**] AM", "ptosis Yr yr yr", "24:30 PM", strict=True)
    assert strict == ["<hour>", "ptosis years years years", "24:30 PM"]


def test_no_span_is_left(spark):
    texts = [f"x [**{inner}**] y" for inner in ("", " ", "un", "Last Name", "*", "a**]b")]
    assert all("[**" not in out for out in run(spark, R.process_notes, *texts))
