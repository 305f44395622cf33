"""Text files besides sequences: boxes, results and lists of unmatched motifs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.params import Box


def parse_boxes(text: str) -> tuple[Box, ...]:
    """The number of gaps, then four numbers for each: smallest and largest gap, length and errors of the box after it."""
    numbers = [int(x) for x in text.split()]
    if not numbers or len(numbers) < 1 + 4 * numbers[0]:
        raise ValueError("boxes: a number of gaps and four numbers for each")
    return tuple(Box(*numbers[1 + 4 * i : 5 + 4 * i]) for i in range(numbers[0]))


def read_boxes(spark: SparkSession, path: str) -> tuple[Box, ...]:
    return parse_boxes(spark.read.text(path, wholetext=True).first()[0])


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """line, number, and whether it stands in the body: after the header's blank line and before the next one."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split("value", "\n")).alias("number", "line"), F.array_position(F.split("value", "\n"), "").alias("blank"), F.split("value", "\n").alias("all")).select(
        "number", "line", ((F.col("number") >= F.col("blank")) & (F.col("number") < F.col("blank") + F.array_position(F.slice("all", F.col("blank") + 1, F.size("all")), "") - 1)).alias("body")
    )


def read_result(spark: SparkSession, path: str) -> tuple[DataFrame, int, float]:
    """(motif, u, num_seqs, ratio, v, ordinal; number of sequences; quorum) of a result in the native format.

    The number of sequences is the third word of the header's sixth line, the quorum the fourth of its eighth.
    """
    lines = lines_of(spark, path)
    head = {r.number: r.line.split() for r in lines.filter(F.col("number").isin(5, 7)).collect()}
    n, q = int(head[5][2]), float(head[7][3])
    if n <= 0 or q <= 0:
        raise ValueError("a background has sequences and a quorum")
    return read_motifs(spark, path), n, q


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    """motif, u, num_seqs, ratio, v, ordinal (the line) of the body of a result or of a list of unmatched motifs."""
    parts = F.split(F.trim("line"), r"\s+")
    body = lines_of(spark, path).filter("body").select(parts.alias("p"), "number")
    return body.select(F.col("p")[0].alias("motif"), F.col("p")[1].cast("long").alias("u"), F.col("p")[2].cast("long").alias("num_seqs"), F.col("p")[3].cast("double").alias("ratio"), F.col("p")[4].cast("long").alias("v"), F.col("number").alias("ordinal"))
