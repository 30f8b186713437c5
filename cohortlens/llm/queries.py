"""The operators as queries over the given tables, next to SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import (
    decontamination,
    jaccard_join,
    kneser_ney,
    language_id,
    mixing,
    packing,
    quality_rules,
    sharding,
    token_alignment,
    token_counts,
    turn_repair,
    url_filter,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    # The key only draws the sample; it is no input of a prediction.
    train = docs.filter(fold != 2).select("text", "lang", F.xxhash64("doc_id").alias("key"))
    model = language_id.fit(train)
    held = F.coalesce(fold == 2, F.lit(False)).alias("held_out")
    found = language_id.predict(docs, model, keep=["doc_id", held])
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")


@query("op2_quality_rules", quality_rules.oracle_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir), ["doc_id"])
    return judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir)).select("row.doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op4_kneser_ney")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return kneser_ney.classify(documents(spark, sf_dir), labels)


@query("op5_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir)).drop("row")


@query("op6_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontamination.find_leaks(documents(spark, sf_dir), benchmark)
    return leaks.select("doc_id", "item_id", "n_windows", "item_windows", "coverage")


@query("op7_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = jaccard_join.link_classes(documents(spark, sf_dir))
    return linked.select("row.doc_id", "n_shingles", "component_id")


@query("op9_url_filter")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(pages(spark, sf_dir))
    return judged.select("row.page_id", "host", "path", "rule", "verdict", "score")


@query(
    "op10_warc",
    """
    WITH p AS (
      SELECT page_id, coalesce(html, '') AS payload FROM pages),
    h AS (
      SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM p),
    d AS (
      SELECT page_id, payload_bytes, hex, (
        SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 ((('0x' || substr(hex, 5 * (k // 4)::INT + 1, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31)::INT + 1, 1), '' ORDER BY k)
        FROM range(32) AS r(k)) AS payload_digest
      FROM h),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM d)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
    FROM f""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(pages(spark, sf_dir)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op11_turn_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turn_repair.examine(talks, turn_repair.damage(talks))


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned, _ = token_alignment.align(documents(spark, sf_dir))
    return aligned.select(
        "row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


@query("op13_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir))
    return packed.select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
