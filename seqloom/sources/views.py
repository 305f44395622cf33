"""Sequences built from tables: one string per entity, in the order of its events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_sequences(rows: DataFrame, entity: str, order: list[str], symbol: Column) -> DataFrame:
    """seq_id (the entity), seq: its symbols in order. Rows without entity or symbol, and so empty sequences, are left out.

    A sequence is one string, so one entity's rows come together in one task; there has to be memory for the longest.
    """
    coded = rows.select(F.col(entity).cast("long").alias("seq_id"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), symbol.alias("symbol")).filter("seq_id IS NOT NULL AND symbol IS NOT NULL AND symbol <> ''")
    in_order = F.array_sort(F.collect_list(F.struct(*(f"o{i}" for i in range(len(order))), "symbol")))
    return coded.groupBy("seq_id").agg(in_order.alias("x")).select("seq_id", F.array_join(F.transform("x", lambda s: s["symbol"]), "").alias("seq"))


def coded(column: Column, values: list[str]) -> Column:
    """Each value as its place in the list; another value is an error, a null stays one."""
    out = F.when(column.isNull(), F.lit(None).cast("string"))
    for i, v in enumerate(values):
        out = out.when(column == v, str(i))
    return out.otherwise(F.raise_error(F.concat(F.lit("no symbol for "), column)))


def events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_sequences(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", ["ts", "event_id"], coded(F.col("event_type"), ["click", "error", "purchase", "signup", "view"]))


def lineitem_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.concat("l_returnflag", "l_linestatus")
    return build_sequences(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber"], coded(status, ["AF", "AO", "NF", "NO", "RF", "RO"]))


def orders_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_sequences(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey", ["o_orderdate", "o_orderkey"], F.substring("o_orderpriority", 1, 1))


OTHERS = "".join(chr(i) for i in range(128) if not chr(i).isalpha() and chr(i) != "*")


def documents_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of whole texts, upper-cased, and '*': the protein alphabet has all of A-Z.

    translate() takes the ASCII part of the rest in a fraction of the time that a regular expression takes, and the
    filter looks for the first letter only, so that no text is rewritten twice.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.col("text").rlike("[A-Za-z*]"))
    ascii_letters = F.translate("text", OTHERS, "")
    letters = F.when(F.octet_length(ascii_letters) == F.length(ascii_letters), ascii_letters).otherwise(F.regexp_replace(ascii_letters, "[^A-Za-z*]+", ""))
    return docs.select(F.col("doc_id").alias("seq_id"), F.upper(letters).alias("seq"))
