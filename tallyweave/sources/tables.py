"""Weighted populations read from Parquet tables, with only the columns they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def population(spark: SparkSession, sf_dir: str, name: str, key: str, weight: str, kind: str | None = None) -> DataFrame:
    """(idx, weight) of a table; `kind` casts the weight."""
    w = F.col(weight)
    return table(spark, sf_dir, name).select(F.col(key).cast("long").alias("idx"), (w.cast(kind) if kind else w).alias("weight"))
