"""Replacement of redaction spans and normalization of frequent phrases.

A span is ``[**...**]``. Each rule family is an ordered list; the families are
tried in order and the first hit replaces the span. One pass over the spans of a
note therefore decides everything, as a single CASE per span.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``token`` replaces a span whose lowercased text passes every given test."""

    token: str
    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    pattern: str | None = None

    def test(self, text: Column) -> Column:
        alternatives = [text.contains(word) for word in self.any_of]
        if self.pattern is not None:
            alternatives.append(text.rlike(self.pattern))
        hit = F.lit(True)
        for word in self.all_of:
            hit = hit & text.contains(word)
        if alternatives:
            either = alternatives[0]
            for alternative in alternatives[1:]:
                either = either | alternative
            hit = hit & either
        return hit


# ---------------------------------------------------------------------------
# Tokens, the words that select them and their order.
# ---------------------------------------------------------------------------

NAME_RULES = (
    Rule("<docln>", all_of=("name", "last", "doctor")),
    Rule("<ln>", all_of=("name", "last")),
    Rule("<docfn>", all_of=("name", "first", "doctor")),
    Rule("<fn>", all_of=("name", "first")),
    Rule("<initial>", all_of=("name", "initials")),
    Rule("<name>", all_of=("name",)),
)

PLACE_RULES = (
    Rule("<hosp>", any_of=("hospital",)),
    Rule("<work>", any_of=("company", "university/college")),
    Rule("<loc>", any_of=("location",)),
    Rule("<country>", any_of=("country",)),
    Rule("<state>", any_of=("state",)),
    Rule("<addr>", any_of=("address", "po box")),
)

IDENTIFIER_RULES = (
    Rule("<pagerno>", any_of=("numeric identifier", "pager number")),
    Rule("<radclip>", any_of=("(radiology)",)),
    Rule("<ssn>", any_of=("social security number",)),
    Rule("<mrno>", any_of=("medical record number",)),
    Rule("<age90>", any_of=("age over 90",)),
    Rule("<sno>", any_of=("serial number",)),
    Rule("<unitno>", any_of=("unit number",)),
    Rule("<mdno>", any_of=("md number",)),
    Rule("<phno>", any_of=("telephone/fax",)),
    Rule("<pno>", any_of=("provider number",)),
    Rule("<jobno>", any_of=("job number",)),
    Rule("<dictinfo>", any_of=("dictator info",)),
    Rule("<contact>", any_of=("contact info",)),
    Rule("<attending>", any_of=("attending info",)),
)

DATE_RULES = (
    Rule("<date>", pattern=r"(?U)\d{4}-\d{0,2}-\d{0,2}"),
    Rule("<mmdd>", any_of=("month/day",), pattern=r"[-/]"),
    Rule("<year>", any_of=("year",), pattern=r"(?U)\b\d{4}\b"),
    Rule("<month>", any_of=("month",)),
    Rule("<hols>", any_of=("holiday",)),
    Rule("<dtrange>", any_of=("date range",)),
)

DIGIT_RULES = (
    Rule("<3digit>", pattern=r"(?U)\d\d\d"),
    Rule("<2digit>", pattern=r"(?U)\d\d"),
    Rule("<1digit>", pattern=r"(?U)\d"),
)

ALL_RULES = NAME_RULES + PLACE_RULES + IDENTIFIER_RULES + DATE_RULES + DIGIT_RULES

SPAN = r"(?d)\[\*\*(.*?)\*\*\]"
CLOCK = r"(?iU)\d{0,2}:\d{0,2} \b[A|P]\.?M\.?\b"
REDACTED_HOUR = r"(?idU)\[\*\*(\d{2})\*\*\] \b[a|p].?m.?\b"
YEAR_OLD = r"(?iU)-?\byears? ?-?old\b|\by(?:o|r)*[ ./-]*o(?:ld)?\b"
NUMBER_YEAR_OLD = (
    r"(?idU)(\d+)\s*(year\s*old|y.\s*o.|yo|year\s*old|year-old|-year-old|-year old)"
)
YEARS = r"(?U)\byr['s]*\b"
PATIENT = r"(?dU)\b[P|p]t.?|\b(IN|OU?T) PT\b"
MALE = r"(?U)\b(gentlman|male|man|m|M)(?!\S)\b"
FEMALE = r"(?U)\b(female|woman|f|F)(?!\S)\b"

# First hour of each part of the day.
DAY_PARTS = (
    (0, "<midnight>"),
    (4, "<dawn>"),
    (8, "<forenoon>"),
    (12, "<afternoon>"),
    (16, "<dusk>"),
    (20, "<night>"),
)


def _bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value computed once, however often ``fn`` uses it."""
    return F.transform(F.array(value), fn)[0]


def replace_spans(text: Column, pattern: str, fn: Callable[[Column], Column]) -> Column:
    """Replace every match of ``pattern`` by ``fn(match)``, keeping the rest as it is."""

    def weave(t: Column, spans: Column) -> Column:
        pieces = F.split(t, pattern, -1)
        woven = F.zip_with(
            pieces, F.transform(spans, fn), lambda piece, span: F.concat(piece, F.coalesce(span, F.lit("")))
        )
        return F.when(F.size(spans) > 0, F.array_join(woven, "")).otherwise(t)

    def rewrite(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return _bind(found, lambda spans: weave(t, spans))

    return _bind(text, rewrite)


def apply_rules(span: Column, rules: Sequence[Rule]) -> Column:
    """Token of the first rule the span passes; null when it passes none."""

    def decide(low: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for rule in rules:
            out = out.when(rule.test(low), rule.token)
        return out

    return _bind(F.lower(span), decide)


def redact(text: Column, rules: Sequence[Rule]) -> Column:
    return replace_spans(text, SPAN, lambda span: F.coalesce(apply_rules(span, rules), span))


def redact_names(text: Column) -> Column:
    return redact(text, NAME_RULES)


def redact_places(text: Column) -> Column:
    return redact(text, PLACE_RULES)


def redact_identifiers(text: Column) -> Column:
    return redact(text, IDENTIFIER_RULES)


def redact_dates(text: Column) -> Column:
    return redact(text, DATE_RULES)


def redact_digits(text: Column) -> Column:
    return redact(text, DIGIT_RULES)


def replace_redacted(text: Column) -> Column:
    return redact(text, ALL_RULES)


def _day_part(clock: Column, strict: bool) -> Column:
    """Part of the day for ``H:MM AM``; the minute digits when the time is not valid."""
    low = F.lower(clock)
    hour_text = F.regexp_extract(low, r"(?U)^(\d*):", 1)
    minute_text = F.regexp_extract(low, r"(?U)^\d*:(\d*)", 1)
    blank_hour = hour_text.isin("", "00")
    minute_text = F.when(blank_hour & (minute_text == ""), "00").otherwise(minute_text)
    hour = F.when(blank_hour, F.lit(12)).otherwise(hour_text.try_cast("int"))
    hour = F.when(hour > 12, hour % 12).otherwise(hour)
    minute = minute_text.try_cast("int")
    morning = F.regexp_extract(low, r"\s(\S)", 1) == "a"
    hour24 = hour % 12 + F.when(morning, 0).otherwise(12)
    part = F.lit(None).cast("string")
    for first, token in DAY_PARTS:
        part = F.when(hour24 >= first, token).otherwise(part)
    valid = hour.between(1, 12) & minute.between(0, 59)
    return F.when(F.coalesce(valid, F.lit(False)), part).otherwise(clock if strict else minute_text)


def time_of_day_token(text: Column, strict: bool = False) -> Column:
    return replace_spans(text, CLOCK, lambda clock: _day_part(clock, strict))


def hour_token(text: Column) -> Column:
    return F.regexp_replace(text, REDACTED_HOUR, "<hour>")


def norm_year_old(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, YEAR_OLD, " yo"), NUMBER_YEAR_OLD, "$1 yo")


def norm_years(text: Column, strict: bool = False) -> Column:
    """The first two hits, case-sensitive; with ``strict`` every hit in any case."""
    if strict:
        return F.regexp_replace(text, "(?i)" + YEARS, "years")
    return F.array_join(F.split(text, YEARS, 3), "years")


def norm_patient(text: Column, strict: bool = False) -> Column:
    """With ``strict`` only the whole word pt, without it also words that start with pt."""
    pattern = r"(?U)\b[Pp]t\b\.?|\b(IN|OU?T) PT\b" if strict else PATIENT
    return F.regexp_replace(text, pattern, "patient ")


def norm_sex(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, MALE, "male"), FEMALE, "female")


def strip_leftover_spans(text: Column) -> Column:
    return F.regexp_replace(text, SPAN, "")


def process_notes(text: Column, strict: bool = False) -> Column:
    """All replacements in order, one projection.

    With ``strict`` a redacted hour is recognized before its digits are replaced
    and the loose rules above are tightened.
    """
    out = hour_token(text) if strict else text
    out = replace_redacted(out)
    out = norm_year_old(out)
    out = norm_years(out, strict)
    out = norm_patient(out, strict)
    out = norm_sex(out)
    out = time_of_day_token(out, strict)
    out = hour_token(out)
    return strip_leftover_spans(out)
