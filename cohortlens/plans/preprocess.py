"""Raw notes to processed notes: one lazy plan, one shuffle (the deduplication)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import redaction, text
from cohortlens.operators.reshape import drop_duplicates


def preprocess(raw: DataFrame, tokenizer: text.Tokenizer = text.note_tokens, scrub: bool = False) -> DataFrame:
    """Deduplicate, assemble ``note``, group ethnicity, tokenize into ``processed_note``."""
    note = text.note_concat(F.col("category"), F.col("description"), F.col("text"))
    out = drop_duplicates(raw).withColumn("note", note)
    scrubbed = redaction.process_notes(F.col("note")) if scrub else F.col("note")
    return (
        out.withColumn("ethnicity", text.group_ethnicity(F.col("ethnicity")))
        .withColumn("processed_note", text.tokenize_note(scrubbed, tokenizer))
        .drop("text", "description")
    )
