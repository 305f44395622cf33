"""Helpers that several operators share: reading tables, shared storage, column hygiene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.storage import discard, materialise, small_batches

__all__ = ["bounded", "discard", "materialise", "partitions", "rows_with", "small_batches", "table", "whole_text"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str = "text") -> Column:
    """The text with null as the empty text."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BROADCAST_IDS = 1_000_000  # ids that are broadcast at most; more are joined by shuffle


def rows_with(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """docs whose key is (left_semi) or isn't (left_anti) in ids, a written table; broadcast up to BROADCAST_IDS."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids.hint("merge"), key, how).select(docs.columns)


BROADCAST_ROWS = 100_000  # of a table of a few columns


def bounded(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has BROADCAST_ROWS at most."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
