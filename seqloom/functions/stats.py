"""Binomial tails, quorums and ratios as column expressions."""

from __future__ import annotations

from math import factorial, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def log_factorials(spark: SparkSession, n: int) -> DataFrame:
    """i, log_factorial for i in 0..n. For tables of a bounded n; binomial_tail() needs none."""
    return spark.range(n + 1).select(F.col("id").alias("i"), F.sum(F.when(F.col("id") > 0, F.log(F.col("id").cast("double"))).otherwise(0.0)).over(W.orderBy("id")).alias("log_factorial"))


#: Of the series for log_gamma(), as C libraries have them.
SERIES = (4.18938533204672725052e-01, 8.33333333333329678849e-02, -2.77777777728775536470e-03, 7.93650558643019558500e-04, -5.95187557450339963135e-04, 8.36339918996282139126e-04, -1.63092934096575273989e-03)


def log_gamma(x: Column) -> Column:
    """lgamma of a whole number of 1 at least, with the C library's operations in their order, so that both round alike."""
    square = 1.0 / x * (1.0 / x)
    rest = F.lit(SERIES[-1])
    for s in SERIES[-2:0:-1]:
        rest = s + square * rest
    small = F.element_at(F.array(*(F.lit(log(factorial(i))) for i in range(7))), F.least(x, F.lit(7)).cast("int"))
    return F.when(x < 8, small).otherwise((x - 0.5) * (F.log(x) - 1.0) + (SERIES[0] + 1.0 / x * rest))


def binomial_tail(x: Column, n: Column, p: Column) -> Column:
    """P(X >= x) for X ~ Bin(n, p), summed directly from the tail's own terms. 1 for x = 0 or p >= 1; x > n is an error.

    Logarithms of factorials of thousands are large, and their last bits show in the tenth digit that reports print. So
    the terms are those of the usual formula with lgamma, rounded in its order: other orders print other digits.
    """
    x, n, p = x.cast("long"), n.cast("long"), p.cast("double")
    start = F.struct(F.lit(0.0).alias("total"), log_gamma((n + 1).cast("double")).alias("all"), F.log(p).alias("hit"), F.log(1.0 - p).alias("miss"))
    term = lambda s, i: F.exp(s["all"] - log_gamma((i + 1).cast("double")) - log_gamma((n - i + 1).cast("double")) + i * s["hit"] + (n - i) * s["miss"])
    step = lambda s, i: F.struct((s["total"] + term(s, i)).alias("total"), s["all"].alias("all"), s["hit"].alias("hit"), s["miss"].alias("miss"))
    tail = F.aggregate(F.sequence(x, n), start, step, lambda s: s["total"])
    return (
        F.when(x > n, F.raise_error(F.lit("binomial_tail: x > n")).cast("double"))
        .when((x <= 0) | (p >= 1), F.lit(1.0))
        .when(p <= 0, F.lit(0.0))
        .otherwise(F.least(tail, F.lit(1.0)))
    )


def ratio(u: Column, n: Column) -> Column:
    return F.when(n > 0, u.cast("double") / n)


def within_quorum(u: Column, n: Column, q: float, q_max: float) -> Column:
    """u of n sequences lie within the percentages, in this order of floating-point operations: u / n * 100."""
    share = ratio(u, n) * 100
    return (share >= F.lit(float(q))) & (share <= F.lit(float(q_max)))


def absolute_quorum(q: Column | float, n: Column) -> Column:
    """The least number of sequences that q percent mean."""
    return F.ceil((q if isinstance(q, Column) else F.lit(float(q))) * n / 100.0)


def printed_pvalue(p: Column) -> Column:
    """Ten significant digits, rounded up, and the exponent unless it is 0: 1.111111112e-1 for 1/9; 0 for 0.

    Rounds the thirteenth digit to the nearest first, so that the sums' own errors don't count as something above.
    """
    said = F.format_string("%.12e", p)
    digits, exponent = F.translate(F.substring(said, 1, 14), ".", "").cast("long"), F.substring_index(said, "e", -1).cast("int")
    up = F.floor((digits + 999) / 1000)
    carry = up == 10**10
    text, exponent = F.when(carry, F.lit(str(10**9))).otherwise(up.cast("string")), exponent + carry.cast("int")
    value = F.concat(F.substring(text, 1, 1), F.lit("."), F.substring(text, 2, 9), F.when(exponent != 0, F.concat(F.lit("e"), exponent.cast("string"))).otherwise(""))
    return F.when(p == 0, "0").otherwise(value)
