"""Word expressions: variants for similarity joins, mismatches, symbol codes."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mismatches(a: Column, b: Column, k: int) -> Column:
    """Positions at which two words of k symbols differ."""
    return sum((F.substring(a, i, 1) != F.substring(b, i, 1)).cast("int") for i in range(1, k + 1))


def masks(word: Column, k: int, e: int) -> Column:
    """The word with each choice of e positions blanked: two words share one if and only if they differ in e at most."""
    out = []
    for gone in combinations(range(k), e):
        parts, at = [], 0
        for g in gone:
            if g > at:
                parts.append(F.substring(word, at + 1, g - at))
            parts.append(F.lit("\u0001"))
            at = g + 1
        if at < k:
            parts.append(F.substring(word, at + 1, k - at))
        out.append(F.concat(*parts) if parts else word)
    return F.array(*out)


def seeds(word: Column, k: int, e: int) -> Column:
    """The word cut into e + 1 pieces with their numbers: words that differ in e positions at most share one."""
    cuts = [k * i // (e + 1) for i in range(e + 2)]
    return F.array(*(F.concat(F.lit(f"{i}:"), F.substring(word, a + 1, b - a)) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))))


def deletions(word: Column, e: int) -> Column:
    """The word with up to e symbols deleted: words at an edit distance of at most e share one."""
    shorter = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    level = F.array(word)
    out = level
    for _ in range(e):
        level = F.array_distinct(F.flatten(F.transform(level, lambda s: F.when(F.length(s) > 0, shorter(s)).otherwise(F.array(s)))))
        out = F.array_union(out, level)
    return out


def smile_id(motif: Column, symbols: str) -> Column:
    """Each symbol as the character that follows '0' by its place in the alphabet; '_' between boxes becomes '-'."""
    return F.translate(motif, symbols + "_", "".join(chr(ord("0") + i) for i in range(len(symbols))) + "-")
