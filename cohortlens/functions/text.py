"""Text expressions: note assembly, tokenizers and n-grams. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Tokenizer = Callable[[Column], Column]

# Letters, digits and underscore in any script. Java's \w and \b cover other
# characters with and without its Unicode flag, so the class is written out.
WORD = r"[\p{L}\p{N}_]"

# Ethnicity groups, first hit wins.
ETHNICITY_GROUPS = ("white", "black", "hispanic", "asian")


def note_concat(*parts: Column) -> Column:
    """Parts joined by newlines; null when any part is null (unlike concat_ws)."""
    pieces = [parts[0]]
    for part in parts[1:]:
        pieces += [F.lit("\n"), part]
    return F.concat(*pieces)


def group_ethnicity(raw: Column) -> Column:
    low = F.lower(raw)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for group in ETHNICITY_GROUPS:
        out = out.when(low.contains(group), group)
    return out.otherwise("unknown")


def note_length(note: Column) -> Column:
    return F.length(note)


def word_tokens(text: Column) -> Column:
    """Lowercased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD + "{2,}"), F.lit(0))


def whitespace_tokens(text: Column) -> Column:
    """Maximal runs without whitespace, case kept."""
    return F.regexp_extract_all(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))


def note_tokens(text: Column) -> Column:
    """Words, kept whole across inner hyphens, apostrophes and dots, and single symbols."""
    word = r"[\p{L}\p{M}\p{N}_]+"
    return F.regexp_extract_all(
        text, F.lit(rf"(?U){word}(?:[-'.]{word})*|[^\p{{L}}\p{{M}}\p{{N}}_\s]"), F.lit(0)
    )


def tokenize_note(text: Column, tokenizer: Tokenizer = note_tokens) -> Column:
    """Tokens joined by one space; pass a tokenizer to use another token rule."""
    return F.array_join(tokenizer(text), " ")


def bigrams(tokens: Column) -> Column:
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(
        F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)
    )


def ngrams_1_2(tokens: Column) -> Column:
    """Unigrams followed by space-joined bigrams."""
    return F.concat(tokens, bigrams(tokens))
