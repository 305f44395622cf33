"""Comparison with a background result, and re-search of motifs in other sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.stats import binomial_tail, ratio
from seqloom.operators.extract import count_occurrences, number_of, thresholds
from seqloom.params import MotifParams


def compare(foreground: DataFrame, background: DataFrame, bg_num_seqs: int | Column, bg_q: float) -> DataFrame:
    """All foreground motifs with matched, bg_ratio, bg_v (0 if unmatched) and pvalue.

    The join is exact. A matched motif's p-value takes the background's ratio, rounded to 6 places as results print it;
    an unmatched one's takes bg_q, the percentage as it stands, over bg_num_seqs.
    """
    if not isinstance(bg_num_seqs, Column):
        if bg_num_seqs <= 0 or bg_q <= 0:
            raise ValueError("a background has sequences and a quorum")
        bg_num_seqs = F.lit(bg_num_seqs)
    other = background.dropDuplicates(["motif"]).select("motif", F.round("ratio", 6).alias("bg_ratio"), F.col("v").alias("bg_v"))
    both = foreground.join(other, "motif", "left").withColumn("matched", F.col("bg_v").isNotNull())
    p = F.when(F.col("matched"), F.col("bg_ratio")).otherwise(F.lit(float(bg_q)) / bg_num_seqs)
    return both.withColumn("p", p).withColumn("pvalue", binomial_tail(F.col("u"), F.col("num_seqs"), F.col("p"))).drop("p").fillna(0, ["bg_ratio", "bg_v"])


def matched(foreground: DataFrame, background: DataFrame, bg_num_seqs: int | Column, bg_q: float) -> DataFrame:
    return compare(foreground, background, bg_num_seqs, bg_q).filter("matched").drop("matched")


def unmatched(foreground: DataFrame, background: DataFrame) -> DataFrame:
    """Foreground motifs that the background result lacks."""
    return foreground.join(background.select("motif").distinct(), "motif", "left_anti")


def research(motifs: DataFrame, sequences: DataFrame, params: MotifParams) -> DataFrame:
    """Given motifs (motif, u, num_seqs, ratio, v and others) counted in sequences: fg_* of the motif, bg_ratio, bg_v, pvalue.

    Every given row that lies within the thresholds there comes once; columns besides, such as the order, stay. A motif
    of another length is an error, found before anything else is read.
    """
    if wrong := motifs.filter(F.length("motif") != params.k).select("motif").first():
        raise ValueError(f"not of {params.k} symbols: {wrong.motif}")
    found = thresholds(count_occurrences(motifs.select("motif").distinct(), sequences, params), number_of(sequences), params)
    found = found.select("motif", F.col("u").alias("bg_u"), F.col("num_seqs").alias("bg_n"), F.col("v").alias("bg_v"))
    named = motifs.withColumnsRenamed({"u": "fg_u", "num_seqs": "fg_n", "ratio": "fg_ratio", "v": "fg_v"})
    both = named.join(found, "motif").withColumn("bg_ratio", ratio(F.col("bg_u"), F.col("bg_n")))
    return both.withColumn("pvalue", binomial_tail(F.col("fg_u"), F.col("fg_n"), F.col("bg_ratio"))).drop("bg_u", "bg_n")
