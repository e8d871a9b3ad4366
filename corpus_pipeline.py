"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and is written as
Parquet before the next one reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import bpe, decontaminate, language_id, near_duplicates, repeats
from tallyweave.llm.common import remainder, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, null and empty texts among them; `lang` tells the predicted language of the others. The model learns from the
    labelled rows of `docs`; where there are none, `lang` stays as it is. Repeated rows are judged each, very long texts whole; languages that
    fit equally well: the first by name. An empty table gives an empty table."""
    model = language_id.train(docs, remainder("doc_id", 3) != 1, public_tokenizers.path("piece_bpe_32k.model"))
    return language_id.keep_known(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays (a null id only if all are), of repeated rows one. Null texts stay,
    empty ones are copies of each other."""
    return near_duplicates.keep_one(docs)


def cut_repeated_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes are cut out in all places, and what is left of a broken character with them; n_chars follows the text. Documents of
    which nothing is left go, empty ones among them; null texts stay. Repeated rows are each other's repeats."""
    return repeats.cut_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none, and null and empty items are in no text."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, encoded and decoded; a null text counts as empty. Repeated rows are encoded each."""
    return bpe.digests(bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_windows", cut_repeated_windows),
    ("decontaminate", drop_benchmark_leaks),
    ("bpe", encode_tokens),
]

#: SQL expresses none of language models, alignments and byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
