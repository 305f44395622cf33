"""Motif extraction: counts of approximate occurrences, thresholds, first-seen order."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.stats import absolute_quorum, ratio, within_quorum
from seqloom.functions.words import masks
from seqloom.operators.windows import edit_contexts, kmer_windows, structured_tuples
from seqloom.params import MotifParams
from seqloom.plans import marked, packed
from seqloom.plans.similarity import edit_context_pairs, hamming_pairs
from seqloom.storage import discard, materialise

MASKED = 1 << 20  # words with a mask that are broadcast at most, by the alphabet's size


def number_of(sequences: DataFrame) -> Column:
    """N, the number of sequences that aren't empty, as a scalar subquery."""
    return sequences.filter(F.length("seq") > 0).agg(F.count("*").alias("n")).scalar()


def two_levels(matches: DataFrame, motif: list[str]) -> DataFrame:
    """motif, u (sequences), v (occurrences) from matches (motif, seq_id, cnt)."""
    return matches.groupBy(*motif, "seq_id").agg(F.sum("cnt").alias("cnt")).groupBy(*motif).agg(F.count("*").alias("u"), F.sum("cnt").alias("v"))


def word_counts(sequences: DataFrame, k: int) -> DataFrame:
    """word, seq_id, cnt, end_pos (the first)."""
    return kmer_windows(sequences, k).groupBy("word", "seq_id").agg(F.count("*").alias("cnt"), F.min("end_pos").alias("end_pos"))


def count_occurrences(motifs: DataFrame, texts: DataFrame, params: MotifParams, seen: bool = False) -> DataFrame:
    """motif, u, v over texts (seq_id, seq) for the distinct motifs (motif) of k symbols; those without any are missing.

    seen: the motifs are words of sequences over the alphabet, so that its size bounds their number.
    """
    k, e = params.k, params.e
    if params.distance == "hamming":
        counts = word_counts(texts, k)
        if seen and e and few_masks(params):
            return count_by_masks(motifs, counts, params)
        pairs = hamming_pairs(motifs, counts.select("word").distinct(), k, e)
        return two_levels(pairs.join(counts, "word"), ["motif"])
    counts = edit_contexts(texts, k, e).groupBy("context", "seq_id").agg(F.count("*").alias("cnt"))
    pairs = edit_context_pairs(motifs, counts.select("context").distinct(), k, e)
    return two_levels(pairs.join(counts, "context"), ["motif"])


def few_masks(params: MotifParams) -> bool:
    return len(params.symbols) ** params.k * comb(params.k, params.e) <= MASKED


def count_by_masks(motifs: DataFrame, counts: DataFrame, params: MotifParams) -> DataFrame:
    """count_occurrences() where the alphabet bounds the words: a motif is in a sequence if one of its masks is.

    Masks of a sequence are few and distinct, the motifs' masks are broadcast, and all is dealt out by sequence, so u
    needs no shuffle of pairs of motifs and sequences. v needs only the words' totals.
    """
    k, e = params.k, params.e
    hit = counts.select("seq_id", F.explode(masks(F.col("word"), k, e)).alias("mask")).repartition("seq_id").distinct()
    own = motifs.select("motif", F.explode(masks(F.col("motif"), k, e)).alias("mask"))
    u = hit.join(F.broadcast(own), "mask").select("motif", "seq_id").distinct().groupBy("motif").agg(F.count("*").alias("u"))
    totals = counts.groupBy("word").agg(F.sum("cnt").alias("cnt"))
    v = hamming_pairs(motifs, totals.select("word"), k, e).join(totals, "word").groupBy("motif").agg(F.sum("cnt").alias("v"))
    return u.join(v, "motif").select("motif", "u", "v")


def distinct_texts(sequences: DataFrame) -> DataFrame:
    """seq_id, seq, times: equal sequences as one, with the smallest seq_id (each has its own). Whatever depends on the symbols only is found once for them."""
    return sequences.groupBy("seq").agg(F.min("seq_id").alias("seq_id"), F.count("*").alias("times"))


def count_structured(motifs: DataFrame, texts: DataFrame, params: MotifParams) -> DataFrame:
    """b0, b1, ..., u, v for the distinct tuples of motifs. The text's gaps are chosen independently of the motif's.

    Box by box, a text's words give way to the motifs' words near them, and equal rows of a sequence are added up before
    the next box, so pairs of boxes never meet pairs of boxes. Equal texts go through this as one: their number goes along
    with the id.
    """
    boxes = [f"b{i}" for i in range(len(params.lengths))]
    hamming = params.distance == "hamming"
    texts = distinct_texts(texts).select(F.struct("seq_id", "times").alias("seq_id"), "seq")
    counts = structured_tuples(texts, params, context=not hamming).groupBy(*boxes, "seq_id").agg(F.count("*").alias("cnt"))
    for i, (b, length, e) in enumerate(zip(boxes, params.lengths, params.errors, strict=True)):
        own, words = motifs.select(F.col(b).alias("motif")).distinct(), counts.select(F.col(b).alias("text")).distinct()
        if hamming:
            pairs = hamming_pairs(own, words.withColumnRenamed("text", "word"), length, e).withColumnRenamed("word", "text")
        else:
            pairs = edit_context_pairs(own, words.withColumnRenamed("text", "context"), length, e).withColumnRenamed("context", "text")
        near = counts.join(pairs, counts[b] == pairs["text"]).drop(b, "text").withColumnRenamed("motif", b)
        if i:
            near = near.join(motifs.select(*boxes[: i + 1]).distinct(), boxes[: i + 1], "left_semi")
        counts = near.groupBy(*boxes, "seq_id").agg(F.sum("cnt").alias("cnt"))
    times = F.col("seq_id.times")
    return counts.groupBy(*boxes).agg(F.sum(times).alias("u"), F.sum(times * F.col("cnt")).alias("v"))


def grid_of(texts: DataFrame, params: MotifParams) -> tuple[int, int, marked.Grid | None]:
    """Of distinct texts (seq, times): the number of sequences, that of texts, and the grid if they are to be counted by marks."""
    has = [F.bool_or(F.col("seq").contains(c)).alias(f"c{i}") for i, c in enumerate(params.symbols)]
    number, size, foreign, *found = texts.agg(F.coalesce(F.sum("times"), F.lit(0)), F.count("*"), F.bool_or(F.col("seq").rlike(packed.foreign(params))), *has).first()
    if size < marked.LEAST or foreign:
        return number, size, None
    grid = marked.Grid(params, "".join(c for c, x in zip(params.symbols, found, strict=True) if x))
    return number, size, grid if grid.fits() else None


def thresholds(counts: DataFrame, n: Column, params: MotifParams) -> DataFrame:
    """Adds num_seqs and ratio, and keeps what lies within the quorum and the total of occurrences."""
    return counts.withColumn("num_seqs", n).filter(within_quorum(F.col("u"), F.col("num_seqs"), params.q, params.q_max) & F.col("v").between(params.n_min, params.n_max)).withColumn("ratio", ratio(F.col("u"), F.col("num_seqs")))


def extract_motifs(sequences: DataFrame, params: MotifParams) -> DataFrame:
    """motif, u, num_seqs, ratio, v, first (struct of seq_id and end_pos; structured: also struct_id).

    A motif is a word (structured: the words of all boxes, joined by '_') that occurs literally. u counts sequences with
    an approximate occurrence, v all occurrences. Order by first for the order in which motifs are seen.
    """
    counts = None
    if packed.applies(params) and not few_masks(params):
        sequences = materialise(sequences.select("seq_id", "seq"), "sequences").filter(F.length("seq") > 0)
        size, foreign = sequences.agg(F.count("*"), F.coalesce(F.bool_or(F.col("seq").rlike(packed.foreign(params))), F.lit(False))).first()
        if size and not foreign:
            own = sequences.agg(F.count_distinct("seq_id")).first()[0] == size
            counts = packed.count_packed(sequences, size, params, own)
    n = number_of(sequences) if counts is None else F.lit(size).cast("long")
    if params.boxes:
        boxes = [f"b{i}" for i in range(len(params.lengths))]
        texts, grid = distinct_texts(sequences), None
        if marked.applies(params):
            texts = materialise(distinct_texts(sequences.filter(F.length("seq") > 0)), "texts")
            number, size, grid = grid_of(texts, params)
            if grid is None:
                discard(texts)
                texts = distinct_texts(sequences)
        seen = structured_tuples(texts, params).groupBy(*boxes).agg(F.min(F.struct("seq_id", "end_pos", "struct_id")).alias("first"))
        if grid is None:
            found = thresholds(count_structured(seen.select(*boxes), sequences, params), n, params).join(seen, boxes)
        else:  # a left join, which falls away where first isn't read
            found = thresholds(marked.count_marked(texts, size, grid), F.lit(number).cast("long"), params).join(seen, boxes, "left")
        found = found.withColumn("motif", F.concat_ws("_", *boxes))
    else:
        words = word_counts(sequences, params.k).withColumnRenamed("word", "motif").groupBy("motif")
        first = F.min(F.struct("seq_id", "end_pos")).alias("first")
        if params.e == 0:
            found = thresholds(words.agg(F.count("*").alias("u"), F.sum("cnt").alias("v"), first), n, params)
        elif counts is not None:  # a left join, which falls away where first isn't read
            found = thresholds(counts, n, params).join(words.agg(first), "motif", "left")
        else:
            seen = words.agg(first)
            found = thresholds(count_occurrences(seen.select("motif"), sequences, params, seen=True), n, params).join(seen, "motif")
    return found.select("motif", "u", "num_seqs", "ratio", "v", "first")


def dataset_stats(sequences: DataFrame, q: float) -> DataFrame:
    """num_seqs, total_length, quorum (sequences that q percent mean), over the sequences that aren't empty."""
    return sequences.filter(F.length("seq") > 0).agg(F.count("*").alias("num_seqs"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long").alias("total_length"), absolute_quorum(q, F.count("*")).cast("long").alias("quorum"))
