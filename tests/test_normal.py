"""Distribution function, inverse, p-values and the deflated Sharpe ratio as columns, against the standard library."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from paneltide.functions import normal, scalars


def frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


def test_distribution_function(spark):
    xs = [k / 16 for k in range(-200, 201)] + [2.999999, 3.0, 3.000001, -3.0]
    for x, p in frame(spark, xs).select("x", normal.cdf(F.col("x"))).collect():
        want = 0.5 * math.erfc(-x / math.sqrt(2))
        assert p == pytest.approx(want, rel=1e-11, abs=1e-15) and 0 <= p <= 1


def test_inverse(spark):
    ps = [1e-12, 1e-6, 0.001, 0.02, 0.024, 0.02425, 0.1, 0.3, 0.5, 0.77, 0.975, 0.98, 0.9999999]
    for p, x in frame(spark, ps).select("x", normal.inverse(F.col("x"))).collect():
        assert x == pytest.approx(NormalDist().inv_cdf(p), abs=1e-9)
    assert [r[0] for r in frame(spark, [0.0, 1.0, -1.0]).select(normal.inverse(F.col("x"))).collect()] == [None] * 3


def test_cointegration_pvalue(spark):
    ts = [-30.0, -18.87, -18.85, -6.0, -3.33613, -2.63, -2.62, -2.61, 0.0, 0.9, 0.93, 5.0]
    for t, p in frame(spark, ts).select("x", normal.coint_pvalue(F.col("x"))).collect():
        assert p == pytest.approx(scalars.coint_pvalue(t), abs=1e-12)
    odd = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert [r[0] for r in odd.select(normal.coint_pvalue(F.col("x"))).collect()] == [None, None]


def test_deflated_sharpe(spark):
    rows = [(1.2, 10, -0.5, 4.0, 2.0), (0.3, 500, 0.0, 3.0, 14.0), (2.0, 1, 0.1, 3.0, 1.0), (-0.4, 2, 0.0, 9.0, 0.001)]
    df = spark.createDataFrame(rows, "sharpe double, n_trials int, skew double, kurtosis double, years double")
    for want, r in zip(rows, normal.with_deflated_sharpe(df).collect(), strict=True):
        assert (r["deflated"], r["pvalue"]) == pytest.approx(scalars.deflated_sharpe(*want), abs=1e-9)
