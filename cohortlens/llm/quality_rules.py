"""Quality rules: a threshold table compiled into one projection of text ratios.

Everything is a built-in column expression over one row, so nothing is shuffled and
no Python runs. Edge cases: a null text counts as empty (all measures 0, fails the
base rules); texts of any length are measured whole; repeated rows are judged alike;
an empty table gives an empty table; columns of the input with the names used here do
not clash, since carried columns travel in one struct.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
WINDOW = 8

# Common function words, plain letters only.
STOP_WORDS = (
    "a an and are as at be but by for from he in is it not of on or that the this to was were which with you "
    "das dem den der des die ein eine ist mit nicht sich und von zu auf im es "
    "de des du elle en est et il la le les par pas pour que qui sur un une dans avec au "
    "al como con del el ha las lo los no para por se su una y o"
).split()
STOP_FORMS = tuple(dict.fromkeys(form for w in STOP_WORDS for form in (w, w.capitalize())))


@dataclass(frozen=True)
class Rule:
    """Between ``least`` and ``most`` parts in a thousand of ``part`` per ``whole``."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None

    def broken(self) -> Column:
        part, whole = F.col(self.part) * 1000, F.col(self.whole)
        low = part < whole * self.least if self.least is not None else F.lit(False)
        high = part > whole * self.most if self.most is not None else F.lit(False)
        return low | high


RULES = (
    Rule("word_length", "word_chars", "n_words", least=2_000, most=20_000),
    Rule("symbols", "n_symbols", "n_words", most=100),
    Rule("stop_words", "n_stop_words", "n_words", least=20),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=500),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", most=300),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=900),
)
MIN_WORDS = 20
MOST_REPEATED_PERCENT = 30


def measure(df: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` in a struct ``row``, and the counts that the rules compare."""
    words, lines, fours = F.col("words"), F.col("lines"), F.col("fours")
    out = df.select(
        F.struct(*[F.col(c) for c in keep]).alias("row"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    inner = F.btrim("text", F.lit(SPACES))
    out = out.select(
        "row",
        F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+")).alias("words"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: _inner(x) != "").alias("lines"),
    )
    out = out.select(
        "*",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _count(lines, lambda x: _inner(x).endswith("...") | _inner(x).endswith("…")).alias("n_ellipsis_lines"),
        _count(lines, lambda x: F.substring(_inner(x), 1, 1).isin("-", "*", "•")).alias("n_bullet_lines"),
        _count(words, lambda x: x.isin(*STOP_FORMS)).alias("n_stop_words"),
        F.transform(words, lambda x: F.xxhash64(x)).alias("ones"),
    ).drop("words", "lines")
    # Windows of one, two and four words. Places are looked up one by one: a slice would
    # copy the whole array each time. A pair beyond the end is null and hashes as such.
    for short, long, width in (("ones", "twos", 1), ("twos", "fours", 2)):
        out = out.select(
            "*", F.transform(short, lambda h, i: F.xxhash64(h, F.get(F.col(short), i + width))).alias(long)
        ).drop(short)
    # Only a text with a repeated window of four words can repeat eight, and pays for the sort.
    repeated = (F.col("n_words") >= WINDOW) & (F.size(F.array_distinct(fours)) < F.size(fours))
    eights = F.transform(
        F.sequence(F.lit(0), F.size(fours) - WINDOW),
        lambda i: F.struct(F.xxhash64(F.get(fours, i), F.get(fours, i + 4)).alias("h"), i.alias("at")),
    )
    out = out.withColumn("placed", F.when(repeated, F.sort_array(eights))).drop("fours")
    placed = F.col("placed")
    last = F.size(placed) - 1
    out = out.withColumn(
        "places",
        F.sort_array(
            F.transform(
                F.filter(
                    placed,
                    lambda e, i: ((i > 0) & (F.get(placed, i - 1)["h"] == e["h"]))
                    | ((i < last) & (F.get(placed, i + 1)["h"] == e["h"])),
                ),
                lambda e: e["at"],
            )
        ),
    )
    places = F.col("places")
    span = F.transform(places, lambda p, i: F.least(F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    out = out.withColumn(
        "n_repeat_words",
        F.coalesce(F.aggregate(span, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")),
    )
    # A filter on this count is not pushed below the projections, where it would repeat their
    # expressions many times over: it needs a column that is made here.
    out = out.withColumn("at", F.spark_partition_id()).drop("placed", "places")
    return out.withColumn("n_repeat_words", F.when(F.col("at") >= 0, F.col("n_repeat_words"))).drop("at")


def _inner(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def _count(items: Column, test) -> Column:
    return F.size(F.filter(items, test)).cast("long")


def judge(df: DataFrame, keep: Sequence[str], text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Measures, ``base_failed``, one boolean per rule and ``kept``, next to ``row``."""
    out = measure(df, keep, text)
    base = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT
    )
    broken = {f"broke_{r.name}": r.broken() for r in rules}
    any_broken = F.lit(False)
    for test in broken.values():
        any_broken = any_broken | test
    return out.select(
        "*",
        base.alias("base_failed"),
        *[test.alias(name) for name, test in broken.items()],
        (~base & ~any_broken).alias("kept"),
    )


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, unchanged."""
    return judge(docs, docs.columns, text, rules).filter("kept").select("row.*")


def _sql_rule(r: Rule) -> str:
    tests = []
    if r.least is not None:
        tests.append(f"{r.part} * 1000 < {r.whole} * {r.least}")
    if r.most is not None:
        tests.append(f"{r.part} * 1000 > {r.whole} * {r.most}")
    return "(" + " OR ".join(tests) + ")"


def oracle_sql(rules: Sequence[Rule] = RULES) -> str:
    """DuckDB SQL for the same rows over ``documents``."""
    stop = ", ".join(f"'{w}'" for w in STOP_FORMS)
    return f"""
    WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
    w AS (
      SELECT rid, doc_id, x, regexp_extract_all(x, '{WORD}') AS words,
             list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines
      FROM t),
    win AS (
      SELECT rid, i, count(*) OVER (PARTITION BY rid, list_slice(words, i, i + {WINDOW - 1})) AS c
      FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
    rep AS (
      SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n
      FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM win WHERE c > 1) GROUP BY rid),
    m AS (
      SELECT doc_id, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
             len(regexp_replace(x, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
             len(list_filter(words, lambda w: w IN ({stop}))) AS n_stop_words,
             len(list_filter(lines, lambda l: regexp_matches(l, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS n_ellipsis_lines,
             len(list_filter(lines, lambda l: regexp_matches(l, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS n_bullet_lines
      FROM w LEFT JOIN rep USING (rid)),
    b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT ({" OR ".join(_sql_rule(r) for r in rules)}) AS kept
    FROM b"""
