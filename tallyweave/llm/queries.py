"""The queries of this package: each applies one operator to its whole table. ORACLE_SQL has DuckDB's form where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_text, language_id, near_duplicates, quality, repeats, token_counts, topk, url_filter
from .common import remainder, table

Query = Callable[[SparkSession, str], DataFrame]


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 5) == 0
    machine = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    scores = quality.score(docs, machine)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 3) == 1
    model = language_id.train(docs, ~held_out, public_tokenizers.path("piece_bpe_32k.model"))
    return language_id.predict(docs, model, "doc_id").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = repeats.remove_repeats(docs.select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["first"])
    return cut.select(
        "doc_id",
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_decontaminate, op2_top_k, op3_near_duplicates, op4_html_text, op5_url_filter, op6_quality, op7_bpe_round_trip, op8_token_counts, op9_language_id, op10_repeated_windows)}
ORACLE_SQL: dict[str, str] = {"op2_top_k": topk.oracle_sql(), "op5_url_filter": url_filter.oracle_sql()}
