"""Text functions and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import redaction, scalar, text
from cohortlens.operators import cohort
from cohortlens.plans import curves
from contract.registry import query, rounded
from contract.tables import N, T1, TERMS_SQL, WORDS, X, notes, redacted_notes, table, talks

DOCS = "documents"


@query(
    "note_concat",
    """SELECT doc_id, lang || chr(10) || CASE WHEN doc_id % 5 <> 0 THEN source END || chr(10) || text AS note FROM documents""",
)
def note_concat(spark, d):
    parts = table(spark, d, DOCS).select(
        "doc_id", "lang", F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("description"), "text"
    )
    return parts.select("doc_id", text.note_concat(F.col("lang"), F.col("description"), F.col("text")).alias("note"))


@query(
    "group_ethnicity",
    f"""WITH {N} SELECT row_id, CASE WHEN lower(ethnicity) LIKE '%white%' THEN 'white' WHEN lower(ethnicity) LIKE '%black%'
      THEN 'black' WHEN lower(ethnicity) LIKE '%hispanic%' THEN 'hispanic' WHEN lower(ethnicity) LIKE '%asian%' THEN 'asian'
      ELSE 'unknown' END AS ethnicity FROM n""",
)
def group_ethnicity(spark, d):
    return notes(spark, d).select("row_id", text.group_ethnicity(F.col("ethnicity")).alias("ethnicity"))


_W = r"[\p{L}\p{M}\p{N}_]+"
_TOKENS = _W + r"(?:[-''.]" + _W + r")*|[^\p{L}\p{M}\p{N}_\s\x0b\x1c-\x1f\x85\p{Z}]"


@query("tokenize_note", f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{_TOKENS}'), ' ') AS processed_note FROM documents")
def tokenize_note(spark, d):
    return table(spark, d, DOCS).select("doc_id", text.tokenize_note(F.col("text")).alias("processed_note"))


@query("note_length", "SELECT doc_id, length(text)::INTEGER AS n FROM documents")
def note_length(spark, d):
    return table(spark, d, DOCS).select("doc_id", text.note_length(F.col("text")).alias("n"))


@query(
    "whitespace_tokens",
    r"""SELECT doc_id, array_to_string(regexp_extract_all(text, '[^\s\x0b\x1c-\x1f\x85\p{Z}]+'), '|') AS tokens FROM documents""",
)
def whitespace_tokens(spark, d):
    return table(spark, d, DOCS).select("doc_id", F.array_join(text.whitespace_tokens(F.col("text")), "|").alias("tokens"))


@query("word_tokens", f"SELECT doc_id, array_to_string({WORDS.format('text')}, '|') AS tokens FROM documents")
def word_tokens(spark, d):
    return table(spark, d, DOCS).select("doc_id", F.array_join(text.word_tokens(F.col("text")), "|").alias("tokens"))


@query(
    "ngrams_1_2",
    f"""WITH {T1}, w AS (SELECT row_id, {WORDS.format('note')} AS w FROM t1)
    SELECT row_id, array_to_string({TERMS_SQL.format('w')}, '|') AS terms FROM w""",
)
def ngrams_1_2(spark, d):
    return talks(spark, d).select(
        "row_id", F.array_join(text.ngrams_1_2(text.word_tokens(F.col("note"))), "|").alias("terms")
    )


_INTERVAL = "trunc((relative_seconds - (SELECT max(relative_seconds) FROM n)) / 43200) / 2 + 0"


@query("interval_bucket", f"WITH {N} SELECT row_id, {_INTERVAL} AS interval FROM n")
def interval_bucket(spark, d):
    timed = cohort.with_relative_time(notes(spark, d))
    return rounded(curves.with_interval(timed, 12).select("row_id", "interval"), "interval")


@query("interval_log", f"WITH {N} SELECT row_id, round(-ln(1 - ({_INTERVAL})), 6) + 0 AS interval FROM n")
def interval_log(spark, d):
    timed = curves.with_interval(cohort.with_relative_time(notes(spark, d)), 12)
    return rounded(timed.select("row_id", scalar.interval_log(F.col("interval")).alias("interval")), "interval")


@query("round_metric", "SELECT o_orderkey, round_even(o_totalprice / 1000, 1) AS value FROM orders")
def round_metric(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", scalar.round_metric(F.col("o_totalprice") / 1000, 1).alias("value")
    )


# --- redaction ------------------------------------------------------------------------------


def _spans(pattern: str, body: str, column: str = "note") -> str:
    """SQL that rewrites every match: split, transform the matches, weave together."""
    pieces = f"string_split_regex({column}, '{pattern}')"
    spans = f"list_transform(regexp_extract_all({column}, '{pattern}'), lambda s: {body})"
    return (
        f"array_to_string(list_transform(range(1, len({pieces}) + 1), "
        f"lambda i: {pieces}[i] || coalesce({spans}[i], '')), '')"
    )


def _has(*words: str) -> str:
    return " AND ".join(f"contains(lower(s), '{w}')" for w in words)


_SPAN = r"\[\*\*(.*?)\*\*\]"
_NAMES = f"""WHEN {_has('name', 'last', 'doctor')} THEN '<docln>' WHEN {_has('name', 'last')} THEN '<ln>'
  WHEN {_has('name', 'first', 'doctor')} THEN '<docfn>' WHEN {_has('name', 'first')} THEN '<fn>'
  WHEN {_has('name', 'initials')} THEN '<initial>' WHEN {_has('name')} THEN '<name>'"""
_PLACES = f"""WHEN {_has('hospital')} THEN '<hosp>' WHEN {_has('company')} OR {_has('university/college')} THEN '<work>'
  WHEN {_has('location')} THEN '<loc>' WHEN {_has('country')} THEN '<country>' WHEN {_has('state')} THEN '<state>'
  WHEN {_has('address')} OR {_has('po box')} THEN '<addr>'"""
_IDS = f"""WHEN {_has('numeric identifier')} OR {_has('pager number')} THEN '<pagerno>'
  WHEN {_has('(radiology)')} THEN '<radclip>' WHEN {_has('social security number')} THEN '<ssn>'
  WHEN {_has('medical record number')} THEN '<mrno>' WHEN {_has('age over 90')} THEN '<age90>'
  WHEN {_has('serial number')} THEN '<sno>' WHEN {_has('unit number')} THEN '<unitno>'
  WHEN {_has('md number')} THEN '<mdno>' WHEN {_has('telephone/fax')} THEN '<phno>'
  WHEN {_has('provider number')} THEN '<pno>' WHEN {_has('job number')} THEN '<jobno>'
  WHEN {_has('dictator info')} THEN '<dictinfo>' WHEN {_has('contact info')} THEN '<contact>'
  WHEN {_has('attending info')} THEN '<attending>'"""
_DATES = rf"""WHEN regexp_matches(s, '\d{{4}}-\d{{0,2}}-\d{{0,2}}') THEN '<date>'
  WHEN contains(s, '-') OR contains(s, '/') THEN '<mmdd>'
  WHEN {_has('year')} OR regexp_matches(s, '\b\d{{4}}\b') THEN '<year>' WHEN {_has('month')} THEN '<month>'
  WHEN {_has('holiday')} THEN '<hols>' WHEN {_has('date range')} THEN '<dtrange>'"""
_DIGITS = r"""WHEN regexp_matches(s, '\d\d\d') THEN '<3digit>' WHEN regexp_matches(s, '\d\d') THEN '<2digit>'
  WHEN regexp_matches(s, '\d') THEN '<1digit>'"""


def _redact(cases: str, column: str = "note") -> str:
    return _spans(_SPAN, f"CASE {cases} ELSE s END", column)


def _redaction_query(name: str, cases: str, fn) -> None:
    @query(name, f"WITH {X} SELECT row_id, {_redact(cases)} AS note FROM x")
    def run(spark, d, fn=fn):
        return redacted_notes(spark, d).select("row_id", fn(F.col("note")).alias("note"))


_redaction_query("redact_names", _NAMES, redaction.redact_names)
_redaction_query("redact_places", _PLACES, redaction.redact_places)
_redaction_query("redact_identifiers", _IDS, redaction.redact_identifiers)
_redaction_query("redact_dates", _DATES, redaction.redact_dates)
_redaction_query("redact_digits", _DIGITS, redaction.redact_digits)
_ALL = f"{_NAMES} {_PLACES} {_IDS} {_DATES} {_DIGITS}"
_redaction_query("replace_redacted", _ALL, redaction.replace_redacted)

_CLOCK = r"(?i)\d{0,2}:\d{0,2} \b[A|P]\.?M\.?\b"
_HOUR = r"regexp_extract(s, '^(\d*):', 1)"
_MIN = r"regexp_extract(s, '^\d*:(\d*)', 1)"
_HH = f"(CASE WHEN {_HOUR} IN ('', '00') THEN 12 WHEN {_HOUR}::INTEGER > 12 THEN {_HOUR}::INTEGER % 12 ELSE {_HOUR}::INTEGER END)"
_MM = f"(CASE WHEN {_HOUR} IN ('', '00') AND {_MIN} = '' THEN '00' ELSE {_MIN} END)"
_BAND = (
    f"CASE WHEN {_HH} BETWEEN 1 AND 12 AND {_MM} <> '' AND TRY_CAST({_MM} AS INTEGER) < 60 THEN "
    "['<midnight>', '<dawn>', '<forenoon>', '<afternoon>', '<dusk>', '<night>']"
    f"[1 + ({_HH} % 12 + CASE WHEN lower(s) LIKE '% a%' THEN 0 ELSE 12 END) // 4] ELSE {_MM} END"
)


def _step(column: str, *rules: tuple[str, str, str]) -> str:
    out = column
    for pattern, to, flags in rules:
        out = f"regexp_replace({out}, '{pattern}', '{to}', '{flags}')"
    return out


_HOUR_RULE = (r"\[\*\*(\d{2})\*\*\] \b[a|p].?m.?\b", "<hour>", "gi")
_YEAR_OLD = (
    (r"-?\byears? ?-?old\b|\by(?:o|r)*[ ./-]*o(?:ld)?\b", " yo", "gi"),
    (r"(\d+)\s*(year\s*old|y.\s*o.|yo|year\s*old|year-old|-year-old|-year old)", r"\1 yo", "gi"),
)
# Without the g flag one hit is replaced; twice for two hits.
_YEARS = ((r"\byr[''s]*\b", "years", "c"), (r"\byr[''s]*\b", "years", "c"))
_PATIENT = ((r"\b[P|p]t.?|\b(IN|OU?T) PT\b", "patient ", "g"),)
_SEX = (
    (r"\b(gentlman|male|man|m|M)(\s|$)", r"male\2", "g"),
    (r"\b(female|woman|f|F)(\s|$)", r"female\2", "g"),
)


def _text_query(name: str, sql: str, fn) -> None:
    @query(name, f"WITH {X} SELECT row_id, {sql} AS note FROM x")
    def run(spark, d, fn=fn):
        return redacted_notes(spark, d).select("row_id", fn(F.col("note")).alias("note"))


_text_query("time_of_day_token", _spans(_CLOCK, _BAND), redaction.time_of_day_token)
_text_query("hour_token", _step("note", _HOUR_RULE), redaction.hour_token)
_text_query("norm_year_old", _step("note", *_YEAR_OLD), redaction.norm_year_old)
_text_query("norm_years", _step("note", *_YEARS), redaction.norm_years)
_text_query("norm_patient", _step("note", *_PATIENT), redaction.norm_patient)
_text_query("norm_sex", _step("note", *_SEX), redaction.norm_sex)
_text_query("strip_leftover_spans", _step("note", (_SPAN, "", "g")), redaction.strip_leftover_spans)


@query(
    "process_notes",
    f"""WITH {X}, a AS (SELECT row_id, {_redact(_ALL)} AS note FROM x),
      b AS (SELECT row_id, {_step('note', *_YEAR_OLD, *_YEARS, *_PATIENT, *_SEX)} AS note FROM a),
      c AS (SELECT row_id, {_spans(_CLOCK, _BAND)} AS note FROM b)
    SELECT row_id, {_step('note', _HOUR_RULE, (_SPAN, '', 'g'))} AS note FROM c""",
)
def process_notes(spark, d):
    return redacted_notes(spark, d).select("row_id", redaction.process_notes(F.col("note")).alias("note"))
