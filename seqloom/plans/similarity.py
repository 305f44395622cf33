"""Similarity joins rewritten as equi-joins.

All strategies are exact and take distinct words, so a join key gathers at most as many words as the alphabet allows,
whatever the number of sequences.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.words import deletions, masks, mismatches, seeds

MOST_MASKS = 128


def hamming_strategy(k: int, e: int) -> str:
    """'equal' without errors, 'mask' while a word has few enough masks, else 'seed'."""
    return "equal" if e == 0 else "mask" if comb(k, e) <= MOST_MASKS else "seed"


def hamming_pairs(motifs: DataFrame, words: DataFrame, k: int, e: int, strategy: str | None = None) -> DataFrame:
    """motif, word for each distinct motif of motifs(motif) and word of words(word), both of k symbols, that differ in e at most."""
    strategy = strategy or hamming_strategy(k, e)
    if strategy == "equal":
        return motifs.join(words, F.col("motif") == F.col("word"))
    make = masks if strategy == "mask" else seeds
    left = motifs.select("motif", F.explode(make(F.col("motif"), k, e)).alias("key"))
    right = words.select("word", F.explode(make(F.col("word"), k, e)).alias("key"))
    both = left.join(right, "key")
    if strategy == "seed":
        both = both.filter(mismatches(F.col("motif"), F.col("word"), k) <= e)
    elif e == 1:  # different words share one mask at most, equal ones all of theirs
        return motifs.join(words, F.col("motif") == F.col("word")).unionByName(both.filter("motif <> word").select("motif", "word"))
    return both.select("motif", "word").distinct()


def edit_pairs(motifs: DataFrame, words: DataFrame, e: int) -> DataFrame:
    """motif, word for each distinct pair at an edit distance of e at most, by their common deletion variants."""
    if e == 0:
        return motifs.join(words, F.col("motif") == F.col("word"))
    left = motifs.select("motif", F.explode(deletions(F.col("motif"), e)).alias("key"))
    right = words.select("word", F.explode(deletions(F.col("word"), e)).alias("key"))
    return left.join(right, "key").select("motif", "word").distinct().filter(F.levenshtein("motif", "word", e) >= 0)


def edit_context_pairs(motifs: DataFrame, contexts: DataFrame, k: int, e: int) -> DataFrame:
    """motif, context for each distinct context of which a suffix is within e edits of the motif."""
    sizes = F.sequence(F.lit(max(1, k - e)), F.least(F.length("context"), F.lit(k + e)))
    suffixes = contexts.filter(F.length("context") >= max(1, k - e)).select("context", F.explode(F.transform(sizes, lambda n: F.right("context", n))).alias("word"))
    near = edit_pairs(motifs, suffixes.select("word").distinct(), e)
    return near.join(suffixes, "word").select("motif", "context").distinct()
