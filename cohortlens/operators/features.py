"""TF-IDF as relations and as ML vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.config import MAX_FEATURES, MIN_DOC_FREQUENCY
from cohortlens.functions import text
from cohortlens.operators.ordering import nth_rows, number_rows
from cohortlens.storage import materialize, scratch_path

HEAVY_TERMS = 20_000
TERMS_PER_TASK = 500_000


@dataclass(frozen=True)
class Weighting:
    """How documents become term weights."""

    terms: Callable[[Column], Column]
    binary: bool
    min_df: int = 1
    max_features: int | None = None


# The three weightings of the study.
MAIN = Weighting(lambda c: text.ngrams_1_2(text.word_tokens(c)), binary=True, max_features=MAX_FEATURES)
SEARCH = Weighting(text.whitespace_tokens, binary=False, min_df=MIN_DOC_FREQUENCY)
SEARCH_BINARY = Weighting(text.whitespace_tokens, binary=True, min_df=MIN_DOC_FREQUENCY)


def with_terms(docs: DataFrame, weighting: Weighting, column: str = "processed_note") -> DataFrame:
    return docs.withColumn("terms", weighting.terms(F.col(column)))


def document_frequency(docs: DataFrame, min_df: int = 1) -> DataFrame:
    """Documents per term. Repeats go before the shuffle, counts are combined map-side."""
    counts = (
        docs.select(F.explode(F.array_distinct("terms")).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )
    return counts.filter(F.col("df") >= min_df) if min_df > 1 else counts


def top_terms(frequencies: DataFrame, k: int) -> DataFrame:
    """The k terms in most documents, ties by term.

    The count at the boundary is found from counts of counts. Only the terms that have
    just this count are put in order, in ranges that follow the terms at hand.
    """
    kept = materialize(frequencies, "frequencies")
    counts = kept.select((-F.col("df")).alias("rare"))
    levels = {"lv1": -F.floor(F.log2(-F.col("rare"))), "lv2": F.col("rare")}
    cut = nth_rows(counts, [], levels, ["rare"], {"k": lambda n: F.least(n, F.lit(k))}, equal=True).first()
    if cut is None:
        return kept.limit(0)
    least = -cut["rare"]
    above = kept.filter(F.col("df") > least)
    rest = k - above.count()
    tied = number_rows(kept.filter(F.col("df") == least), ["term"], "at")
    return above.unionByName(tied.filter(F.col("at") < rest).drop("at"))


def with_index(vocab: DataFrame) -> DataFrame:
    """Alphabetical column index, from zero."""
    return number_rows(vocab, ["term"], "idx")


def vocabulary(docs: DataFrame, weighting: Weighting) -> DataFrame:
    """(term, df, idx) of the terms a weighting keeps."""
    frequencies = document_frequency(docs, weighting.min_df)
    if weighting.max_features is not None:
        frequencies = top_terms(frequencies, weighting.max_features)
    return with_index(frequencies)


def idf_smooth(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def l2_normalize(weights: DataFrame) -> DataFrame:
    """Divide the weights of each row by their Euclidean norm."""
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("row_id")))
    return weights.withColumn("weight", F.col("weight") / norm)


def placed_by_row(docs: DataFrame) -> DataFrame:
    """Rows dealt by id over as many tasks as their terms, counted before, ask for.

    Sizes of shuffled rows say little, as a task makes many times their size of terms.
    """
    n_terms = docs.agg(F.sum(F.size("terms").cast("long"))).first()[0] or 0
    return docs.repartition(1 + max(0, n_terms) // TERMS_PER_TASK, "row_id")


def term_counts(docs: DataFrame, binary: bool) -> DataFrame:
    """(row_id, term, tf). Rows are placed by id first, so that counting the terms of
    a document and normalizing its weights need no further shuffle."""
    if binary:
        reduced = placed_by_row(docs.select("row_id", F.array_distinct("terms").alias("terms")))
        return reduced.select("row_id", F.explode("terms").alias("term"), F.lit(1).cast("long").alias("tf"))
    placed = placed_by_row(docs.select("row_id", "terms"))
    return (
        placed.select("row_id", F.explode("terms").alias("term"))
        .groupBy("row_id", "term")
        .agg(F.count("*").alias("tf"))
    )


def weigh(docs: DataFrame, vocab: DataFrame, n_docs: Column, binary: bool) -> DataFrame:
    """(row_id, term, idx, weight): sublinear tf times smooth idf, rows of norm one.

    The ``HEAVY_TERMS`` terms in most documents meet their weights map-side, as a broadcast
    of at most that many rows; the others, none of them in many rows, join by shuffle.
    """
    vocab = materialize(vocab, "vocabulary")
    counts = term_counts(docs, binary)
    if vocab.limit(HEAVY_TERMS + 1).count() <= HEAVY_TERMS:
        raw = counts.join(F.broadcast(vocab), "term")
    else:
        heavy = materialize(top_terms(vocab, HEAVY_TERMS), "heavy_terms")
        names = F.broadcast(heavy.select("term"))
        light = vocab.join(names, "term", "left_anti")
        raw = counts.join(F.broadcast(heavy), "term").unionByName(counts.join(names, "term", "left_anti").join(light, "term"))
    weight = (1 + F.log("tf")) * idf_smooth(n_docs, F.col("df"))
    return l2_normalize(raw.select("row_id", "term", "idx", weight.alias("weight")))


def _count(docs: DataFrame) -> Column:
    return docs.agg(F.count("*")).scalar()


def tfidf(
    docs: DataFrame, weighting: Weighting, train: DataFrame | None = None, column: str = "processed_note"
) -> DataFrame:
    """Weights of ``docs`` with vocabulary and idf of ``train`` (default: the same table)."""
    fitted = with_terms(docs if train is None else train, weighting, column)
    vocab = vocabulary(fitted, weighting)
    scored = with_terms(docs, weighting, column)
    return weigh(scored, vocab, _count(fitted), weighting.binary)


def tfidf_fixed_vocab(
    docs: DataFrame, terms: DataFrame, weighting: Weighting, column: str = "processed_note"
) -> DataFrame:
    """Weights over a given (term, idx) vocabulary, idf from the scored documents."""
    scored = with_terms(docs, weighting, column)
    vocab = terms.join(document_frequency(scored), "term").select("term", "df", "idx")
    return weigh(scored, vocab, _count(scored), weighting.binary)


def frequency_by_seed(docs: DataFrame, train: dict[int, Column], min_df: int = 1) -> DataFrame:
    """(seed, term, df) over the train rows of every seed, from one pass over the terms.

    ``train`` maps a seed to a boolean expression. Terms are exploded once; each
    seed is one counter of the same aggregation.
    """
    flags = docs.select(
        F.array_distinct("terms").alias("terms"),
        *[F.coalesce(flag, F.lit(False)).cast("int").alias(f"t{seed}") for seed, flag in train.items()],
    )
    counts = (
        flags.withColumn("term", F.explode("terms"))
        .groupBy("term")
        .agg(*[F.sum(f"t{seed}").alias(f"d{seed}") for seed in train])
    )
    entries = F.array(
        *[F.struct(F.lit(seed).alias("seed"), F.col(f"d{seed}").alias("df")) for seed in train]
    )
    return (
        counts.select("term", F.explode(entries).alias("e"))
        .select("e.seed", "term", "e.df")
        .filter(F.col("df") >= min_df)
    )


def vector_stages(vocab: DataFrame, n_docs: int, binary: bool = True) -> list:
    """ML stages from ``terms`` to ``features``; all row-wise in the JVM.

    The vocabulary goes to the driver, as every ML model keeps one weight per term
    there, so it must have a feature cap. idf comes from the document counts at
    hand: no second pass over the texts.
    """
    if not binary:
        raise ValueError("counts above one need assemble_vectors: there is no stage for 1 + ln(tf)")
    rows = vocab.select("idx", "term", idf_smooth(F.lit(n_docs), F.col("df")).alias("idf")).limit(
        MAX_FEATURES + 1
    ).collect()
    if len(rows) > MAX_FEATURES:
        raise ValueError(f"vocabulary above {MAX_FEATURES} terms; set max_features")
    rows.sort(key=lambda r: r["idx"])
    counts = CountVectorizerModel.from_vocabulary([r["term"] for r in rows], inputCol="terms", outputCol="tf")
    counts.setBinary(True)
    scaled = ElementwiseProduct(
        scalingVec=Vectors.dense([r["idf"] for r in rows]), inputCol="tf", outputCol="tfidf"
    )
    return [counts, scaled, Normalizer(p=2.0, inputCol="tfidf", outputCol="features")]


def assemble_vectors(docs: DataFrame, weights: DataFrame, size: int) -> DataFrame:
    """Add ``features`` to every document from its (idx, weight) rows.

    Works for any weighting and keeps the vocabulary out of the driver. A vector is
    stored as the struct that its type is made of and read back as a vector, so no
    Python builds it.
    """
    rows = weights.groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("e")
    )
    empty = F.array().cast("array<struct<idx:bigint,weight:double>>")
    parts = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(int(size)).alias("size"),
        F.transform("e", lambda x: x["idx"].cast("int")).alias("indices"),
        F.transform("e", lambda x: x["weight"]).alias("values"),
    )
    stored = (
        docs.join(rows, "row_id", "left")
        .withColumn("e", F.coalesce("e", empty))
        .select(*docs.columns, parts.alias("features"))
    )
    path = scratch_path(docs.sparkSession, "vectors")
    stored.write.parquet(path)
    schema = T.StructType([*[f for f in stored.schema if f.name != "features"], T.StructField("features", VectorUDT())])
    return docs.sparkSession.read.schema(schema).parquet(path)


def assemble_entries(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """Add ``entries``, the (idx, value) of its weights in order of idx, to every document."""
    rows = weights.groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), F.col("weight").alias("value")))).alias("entries")
    )
    empty = F.array().cast("array<struct<idx:int,value:double>>")
    return docs.join(rows, "row_id", "left").withColumn("entries", F.coalesce("entries", empty))
