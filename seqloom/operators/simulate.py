"""Simulated inputs with implanted motifs, and the accuracy of their extraction.

All that is random is a digest of what it is for and the seed, so a run can be repeated anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions.stats import absolute_quorum
from seqloom.operators.extract import number_of
from seqloom.params import Box

LETTERS = "ACGT"
CELLS = 4096  # into which sequences are dealt for their ranks
SPAN = 1024  # ranks that are joined by one key


def _digest(*of: object) -> Column:
    return F.md5(F.concat_ws("|", *(x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in of)))


def _draw(n: int | Column, *of: object) -> Column:
    """A number below n that the arguments fix."""
    return F.pmod(F.conv(F.substring(_digest(*of), 1, 12), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n)).cast("long")


def _letter(*of: object) -> Column:
    return F.substring(F.lit(LETTERS), (_draw(4, *of) + 1).cast("int"), F.lit(1))


def random_motifs(sequences: DataFrame, count: int, lengths: list[int], seed: int) -> DataFrame:
    """motif_id, w0, w1, ...: random words over A, C, G, T for each box."""
    words = [F.concat(*(_letter("word", F.col("id"), seed, b, i) for i in range(k))).alias(f"w{b}") for b, k in enumerate(lengths)]
    return sequences.sparkSession.range(count).select(F.col("id").alias("motif_id"), *words)


def _mutated(word: Column, k: int, errors: Column, most: int, *of: object) -> Column:
    """The word with random letters at errors random positions, which may coincide or leave the letter as it is."""
    out = word
    for i in range(most):
        at = _draw(k, "at", *of, i).cast("int")
        changed = F.concat(F.substring(out, F.lit(1), at), _letter("letter", *of, i), F.substring(out, at + 2, F.lit(k)))
        out = F.when(errors > i, changed).otherwise(out)
    return out


def ranked(sequences: DataFrame, seed: int) -> DataFrame:
    """seq_id, rank from 0 without gaps, in the order of a digest; ranks within cells, and the cells' sizes before them."""
    placed = sequences.filter(F.length("seq") > 0).select("seq_id", _digest("rank", F.col("seq_id"), seed).alias("digest"))
    placed = placed.withColumn("cell", (F.conv(F.substring("digest", 1, 3), 16, 10).cast("int") % CELLS))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct("cell", "n"))).alias("sizes"))
    before = sizes.select(F.explode(F.transform("sizes", lambda x, i: F.struct(x["cell"].alias("cell"), F.aggregate(F.slice("sizes", 1, i), F.lit(0).cast("long"), lambda t, y: t + y["n"]).alias("before")))).alias("x")).select("x.*")
    own = F.row_number().over(W.partitionBy("cell").orderBy("digest", "seq_id")) - 1
    return placed.withColumn("own", own).join(F.broadcast(before), "cell").select("seq_id", (F.col("before") + F.col("own")).alias("rank"))


def implant(sequences: DataFrame, motifs: DataFrame, q: float, boxes: list[tuple[int, int, int]], gaps: list[int], seed: int) -> DataFrame:
    """seq_id, seq: each motif's mutated copy is appended to as many distinct sequences as q percent mean.

    boxes: (length, fewest errors, most errors) of each; gaps: their smallest gaps, filled with random letters. The
    sequences stand in a random order; a motif's are a run of that order from a random place on, and on from the first
    after the last. Motifs go to a sequence in the order of their ids.
    """
    n = number_of(sequences)
    runs = motifs.withColumn("n", n).filter("n > 0").withColumn("start", _draw(F.col("n"), "start", F.col("motif_id"), seed)).withColumn("end", F.col("start") + absolute_quorum(q, F.col("n")))
    spans = runs.withColumn("span", F.explode(F.sequence(F.floor(F.col("start") / SPAN), F.floor((F.col("end") - 1) / SPAN)))).filter("end > start")
    places = ranked(sequences, seed).withColumn("n", n).withColumn("place", F.explode(F.array("rank", F.col("rank") + F.col("n")))).drop("n")
    chosen = places.withColumn("span", F.floor(F.col("place") / SPAN)).join(spans, "span").filter("place >= start AND place < end")
    parts: list[Column] = []
    for b, (k, low, high) in enumerate(boxes):
        key = (F.col("motif_id"), F.col("seq_id"), seed, b)
        if b:
            parts += [_letter("gap", *key, i) for i in range(gaps[b - 1])]
        parts.append(_mutated(F.col(f"w{b}"), k, _draw(high - low + 1, "errors", *key) + low, high, *key))
    tails = chosen.select("seq_id", "motif_id", F.concat(*parts).alias("tail")).groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("motif_id", "tail"))).alias("x"))
    return sequences.join(tails, "seq_id", "left").select("seq_id", F.concat("seq", F.coalesce(F.array_join(F.transform("x", lambda s: s["tail"]), ""), F.lit(""))).alias("seq"))


def simulate_single(sequences: DataFrame, k: int, e_min: int, e_max: int, q: float, count: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(sequences with implants, motifs (motif))."""
    motifs = random_motifs(sequences, count, [k], seed)
    return implant(sequences, motifs, q, [(k, e_min, e_max)], [], seed), motifs.select(F.col("w0").alias("motif"))


def simulate_structured(sequences: DataFrame, k: int, e: int, boxes: tuple[Box, ...], q: float, count: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(sequences with implants at the smallest gaps, motifs (motif, boxes joined by '_'))."""
    lengths = [k, *(b.length for b in boxes)]
    motifs = random_motifs(sequences, count, lengths, seed)
    out = implant(sequences, motifs, q, [(k, 0, e), *((b.length, 0, b.errors) for b in boxes)], [b.gap_min for b in boxes], seed)
    return out, motifs.select(F.concat_ws("_", *(f"w{b}" for b in range(len(lengths)))).alias("motif"))


def accuracy(implanted: DataFrame, found: DataFrame) -> DataFrame:
    """total, found, accuracy: how many of the implanted motifs a result has, exactly."""
    total = implanted.agg(F.count("*").alias("total"))
    hits = implanted.join(found.select("motif").distinct(), "motif", "left_semi").agg(F.count("*").alias("found"))
    return total.withColumn("found", hits.scalar()).select("total", "found", F.when(F.col("total") > 0, F.col("found") / F.col("total")).alias("accuracy"))
