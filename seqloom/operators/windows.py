"""Words of sequences: windows, contexts and structured tuples. Sequences are (seq_id, seq); ends count from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.params import MotifParams

STRETCH = 64


def stretches(sequences: DataFrame, before: int, after: int, least: int) -> DataFrame:
    """seq_id, base, lead, own, text: sequences of at least so many symbols, cut into stretches.

    A stretch has own symbols from base on, lead symbols in front of them (before, unless the sequence begins sooner)
    and up to after behind them. What is read at a place then costs no walk from the sequence's start, and no row
    carries more than a stretch, whatever the sequence's length.
    """
    size = max(STRETCH, before, after)
    cut = sequences.filter(F.length("seq") >= least).select("seq_id", F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("cut"))
    beside = lambda part: F.coalesce(part, F.lit(""))
    around = F.transform("cut", lambda own, i: F.struct(beside(F.right(F.get("cut", i - 1), F.lit(before))).alias("lead"), own.alias("own"), beside(F.left(F.get("cut", i + 1), F.lit(after))).alias("tail")))
    each = cut.select("seq_id", F.posexplode(around).alias("i", "x"))
    return each.select("seq_id", (F.col("i") * size).cast("long").alias("base"), F.length("x.lead").alias("lead"), F.length("x.own").alias("own"), F.concat("x.lead", "x.own", "x.tail").alias("text"))


def kmer_windows(sequences: DataFrame, k: int) -> DataFrame:
    """seq_id, end_pos, word for every word of k symbols. The length filter stands before the explode."""
    whole = stretches(sequences, 0, k - 1, k).filter(F.length("text") >= k)
    at = whole.select("seq_id", "base", "text", F.explode(F.sequence(F.lit(1), F.least("own", F.length("text") - (k - 1)))).alias("at"))
    return at.select("seq_id", (F.col("base") + F.col("at") + (k - 2)).alias("end_pos"), F.substring("text", F.col("at"), F.lit(k)).alias("word"))


def edit_contexts(sequences: DataFrame, k: int, e: int) -> DataFrame:
    """seq_id, end_pos, context: the up to k + e symbols that end at each position, in sequences of k symbols at least."""
    whole = stretches(sequences, k + e - 1, 0, k)
    at = whole.select("seq_id", "base", "text", "lead", F.explode(F.sequence(F.lit(1), F.col("own"))).alias("at")).filter(F.col("base") + F.col("at") >= max(1, k - e))
    end = F.col("lead") + F.col("at")
    start = F.greatest(end - (k + e) + 1, F.lit(1))
    return at.select("seq_id", (F.col("base") + F.col("at") - 1).alias("end_pos"), F.substring("text", start, end - start + 1).alias("context"))


def gap_structures(sequences: DataFrame, params: MotifParams) -> DataFrame:
    """Every choice of gaps as struct_id, g0, g1, ...: a bounded table made from the parameters."""
    rows = [(i, *g) for i, g in enumerate(params.structures)]
    names = ", ".join(["struct_id int", *(f"g{j} int" for j in range(len(params.boxes)))])
    return sequences.sparkSession.createDataFrame(rows, names)


def structured_tuples(sequences: DataFrame, params: MotifParams, context: bool = False) -> DataFrame:
    """seq_id, end_pos (of box 0), struct_id, b0, b1, ... wherever all boxes end within the sequence.

    A box is its word; with context=True it is the up to length + errors symbols that end where the box does, and box 0
    may begin before the sequence does.
    """
    lengths = params.lengths
    extra = [e if context else 0 for e in params.errors]
    span = sum(b.gap_max + b.length for b in params.boxes)
    whole = stretches(sequences, max(lengths[0] - 1 + extra[0], *extra), span, params.total_length)
    first = max(1, params.k - params.e) if context else params.k
    at = whole.select("seq_id", "base", "text", "lead", F.explode(F.sequence(F.lit(1), F.col("own"))).alias("at")).filter(F.col("base") + F.col("at") >= first)
    placed = at.withColumn("struct", F.explode(F.array(*(F.struct(F.lit(i).alias("id"), *(F.lit(x).alias(f"g{j}") for j, x in enumerate(g))) for i, g in enumerate(params.structures)))))
    end, columns = F.col("lead") + F.col("at"), []
    for b, (length, e) in enumerate(zip(lengths, extra, strict=True)):
        if b:
            end = end + F.col(f"struct.g{b - 1}") + length
        start = F.greatest(end - length - e + 1, F.lit(1))
        columns.append(F.substring("text", start, end - start + 1).alias(f"b{b}"))
    return placed.filter(end <= F.length("text")).select("seq_id", (F.col("base") + F.col("at") - 1).alias("end_pos"), F.col("struct.id").alias("struct_id"), *columns)
