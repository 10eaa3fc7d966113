"""Exact and interval statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def mcnemar(only_a: Column, only_b: Column) -> Column:
    """Exact two-sided p of a paired comparison: twice the lower binomial tail, at most 1; 1 without discordant pairs."""
    n, k = only_a + only_b, F.least(only_a, only_b)
    log_choose = lambda i: F.aggregate(F.sequence(F.lit(1), F.greatest(i, F.lit(1))), F.lit(0.0), lambda s, j: s + F.when(j <= i, F.log((n - j + 1) / j)).otherwise(0.0))
    tail = F.aggregate(F.sequence(F.lit(0), k.cast("int")), F.lit(0.0), lambda s, i: s + F.exp(log_choose(i) - n * F.log(F.lit(2.0))))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * tail))


def wilson(successes: Column, total: Column, z: float = Z95) -> Column:
    """``struct<low, high>`` of the score interval, rounded to four places; zeros for an empty total."""
    p = successes / F.nullif(total, F.lit(0))
    scale = 1 + z * z / total
    mid = p + z * z / (2 * total)
    half = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total))
    low, high = F.greatest((mid - half) / scale, F.lit(0.0)), F.least((mid + half) / scale, F.lit(1.0))
    return F.when(total == 0, F.struct(F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))).otherwise(F.struct(F.round(low, 4).alias("low"), F.round(high, 4).alias("high")))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; of unit vectors their cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(F.round(part / whole, 4))
