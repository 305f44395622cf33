"""FASTA files as sequences."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.params import ALPHABETS


def parse_fasta(files: DataFrame, alphabet: str = "DNA") -> DataFrame:
    """seq_id, header, seq from files (path, value: a whole file).

    A record is '>', a header up to the line's end, and everything up to the next '>', wherever that stands. Line feeds
    go, letters become upper case. Empty records are dropped before seq_id is dealt out, from 0, by path and place.
    Errors: a file that doesn't begin with '>', a blank line between a header and its sequence, a symbol outside the
    alphabet (carriage returns and spaces too).
    """
    symbols = re.escape(ALPHABETS.get(alphabet, alphabet))
    value = F.col("value")
    begun = ((F.length(value) == 0) | value.startswith(">")).alias("begun")
    records = files.select("path", begun, F.posexplode_outer(F.regexp_extract_all(value, F.lit(r">[^\n]*(?:\n[^>]*|$)"), F.lit(0))).alias("place", "record"))
    header, body = F.regexp_extract("record", r"^>([^\n]*)", 1), F.regexp_extract("record", r"(?s)^>[^\n]*\n(.*)$", 1)
    rows = records.select("path", "begun", "place", header.alias("header"), body.alias("body"), F.upper(F.regexp_replace(body, "\n", "")).alias("seq"))
    # errors are raised in the last projection alone, not in the count of what stands before a file
    per_file = rows.filter("length(seq) > 0").groupBy("path").agg(F.count("*").alias("n"))
    before = per_file.select("path", (F.sum("n").over(W.orderBy("path")) - F.col("n")).alias("before"))
    place = F.row_number().over(W.partitionBy("path").orderBy("place")) - 1
    numbered = rows.filter("length(seq) > 0 OR NOT begun").withColumn("own", place).join(F.broadcast(before), "path", "left")
    wrong = F.when(~F.col("begun") | F.col("body").rlike(r"(?s)^\n."), "not in FASTA format: ").when(F.col("seq").rlike(f"[^{symbols}]"), "symbol outside the alphabet in ")
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, "path"))).otherwise(F.col("seq"))
    return numbered.select((F.coalesce("before", F.lit(0)) + F.col("own")).alias("seq_id"), "header", checked.alias("seq"))


def read_fasta(spark: SparkSession, path: str, alphabet: str = "DNA") -> DataFrame:
    """parse_fasta() over all files of a path. A file is read whole by one task; split very large ones."""
    return parse_fasta(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value"), alphabet)


def validated(sequences: DataFrame, alphabet: str) -> DataFrame:
    """The sequences, with an error for any symbol outside the alphabet."""
    symbols = re.escape(ALPHABETS.get(alphabet, alphabet))
    return sequences.withColumn("seq", F.when(F.col("seq").rlike(f"[^{symbols}]"), F.raise_error(F.lit("symbol outside the alphabet"))).otherwise(F.col("seq")))
