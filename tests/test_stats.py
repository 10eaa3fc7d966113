import math

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import stats


def mcnemar(spark, *pairs):
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    return [r.p for r in df.select(stats.mcnemar(F.col("a"), F.col("b")).alias("p")).collect()]


def test_mcnemar(spark):
    pairs = [(0, 0), (10, 10), (12, 15), (1, 20), (4, 17), (17, 4), (600, 700)]
    p = mcnemar(spark, *pairs)
    for (a, b), x in zip(pairs, p, strict=True):
        n = a + b
        assert x == pytest.approx(min(1.0, 2 * sum(math.comb(n, i) for i in range(min(a, b) + 1)) / 2**n) if n else 1.0)
    assert p[2] > 0.05 and p[3] < 0.001 and p[4] == p[5]


def test_wilson(spark):
    df = spark.createDataFrame([(43, 50), (50, 50), (0, 50), (0, 0), (11, 14)], "s bigint, n bigint")
    got = [tuple(r.w) for r in df.select(stats.wilson(F.col("s"), F.col("n")).alias("w")).collect()]
    assert got[0] == pytest.approx((0.7381, 0.9305), abs=1e-3) and got[1][1] == 1.0 and got[2][0] == 0.0 and got[3] == (0.0, 0.0) and got[4] == (0.5241, 0.9243)


def test_dot_and_rate(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], 1, 0)], "a array<float>, b array<float>, x int, y int")
    assert tuple(df.select(stats.dot(F.col("a"), F.col("b")), stats.rate(F.col("x"), F.col("y"))).collect()[0]) == (11.0, 0.0)
