"""The normal distribution as column expressions, and the same formulas as SQL text.

Near zero the distribution function is its power series, in the tails a continued fraction of the upper tail, both to
the precision of doubles. The inverse is a rational approximation, mended by one step of Halley's rule.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the continued fraction takes over, the last odd divisor of the series, and the levels of the fraction.
SPLIT, LAST_ODD, LEVELS = 3.0, 61, 40
ROOT = math.sqrt(2 * math.pi)

# Acklam's rational approximation of the inverse, highest powers first.
CENTRE_OVER = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
CENTRE_UNDER = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
TAIL_OVER = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_UNDER = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
TAIL = 0.02425

# MacKinnon's response surface for a residual test of two series with a constant; lowest powers first.
COINT_HIGH, COINT_LOW, COINT_SPLIT = 0.92, -18.86, -2.62
COINT_SMALL, COINT_LARGE = (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)
#: Euler's constant.
GAMMA = 0.5772156649


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once and not once for each use."""
    return F.transform(F.array(value), body)[0]


def density(x: Column) -> Column:
    return F.exp(-x * x / 2) / ROOT


def cdf(x: Column) -> Column:
    """The chance of a value up to x; null for null."""
    return let(x, _cdf)


def _cdf(x: Column) -> Column:
    series, fraction, a = F.lit(1.0), F.abs(x), F.abs(x)
    for odd in range(LAST_ODD, 1, -2):
        series = 1 + x * x / odd * series
    for k in range(LEVELS, 0, -1):
        fraction = a + k / fraction
    tail = density(x) / fraction
    return F.when(a < SPLIT, 0.5 + density(x) * x * series).when(x < 0, tail).otherwise(1 - tail)


def _horner(x: Column, powers: tuple[float, ...]) -> Column:
    out = F.lit(powers[0])
    for c in powers[1:]:
        out = out * x + c
    return out


def inverse(p: Column) -> Column:
    """The value that a share p lies below; null outside of (0, 1)."""
    return let(p, _inverse)


def _inverse(p: Column) -> Column:
    q = p - 0.5
    r = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _horner(r, TAIL_OVER) / _horner(r, TAIL_UNDER)
    centre = q * _horner(q * q, CENTRE_OVER) / _horner(q * q, CENTRE_UNDER)
    first = F.when(p < TAIL, tail).when(p > 1 - TAIL, -tail).otherwise(centre)
    step = lambda x: (_cdf(x) - p) * ROOT * F.exp(x * x / 2)
    return F.when((p > 0) & (p < 1), let(first, lambda x: let(step(x), lambda u: x - u / (1 + x * u / 2))))


def _polynomial(t, powers: tuple[float, ...]):
    out = powers[-1]
    for c in powers[-2::-1]:
        out = out * t + c
    return out


def coint_pvalue(t: Column) -> Column:
    """The p-value of a cointegration statistic; null for null and NaN."""
    z = F.when(t <= COINT_SPLIT, _polynomial(t, COINT_SMALL)).otherwise(_polynomial(t, COINT_LARGE))
    return F.when(t.isNull() | F.isnan(t), F.lit(None)).when(t > COINT_HIGH, F.lit(1.0)).when(t < COINT_LOW, F.lit(0.0)).otherwise(cdf(z))


def with_deflated_sharpe(rows: DataFrame) -> DataFrame:
    """Adds deflated, the deflated Sharpe ratio, and pvalue. rows: sharpe, n_trials, skew, kurtosis and years among its
    columns. With one trial nothing is deflated and the p-value is 0.

    Column by column, since the analyser resolves nested lambdas a level at a time."""
    low = rows.withColumn("__a", inverse(1 - 1 / F.col("n_trials"))).withColumn("__b", inverse(1 - 1 / (F.col("n_trials") * math.e)))
    periods = F.greatest(F.floor(252 * F.col("years")), F.lit(2))
    variance = (1 - F.col("skew") * F.col("sharpe") + (F.col("kurtosis") - 1) / 4 * F.col("sharpe") * F.col("sharpe")) / (periods - 1)
    scaled = low.withColumn("__d", F.sqrt(F.greatest(variance, F.lit(1e-12))))
    many = F.col("n_trials") > 1
    z = (F.col("sharpe") - ((1 - GAMMA) * F.col("__a") + GAMMA * F.col("__b")) * F.col("__d")) / F.col("__d")
    out = scaled.withColumn("deflated", F.when(many, z).otherwise(F.col("sharpe")))
    return out.withColumn("pvalue", F.when(many, 1 - cdf(F.col("deflated"))).otherwise(0.0)).drop("__a", "__b", "__d")


def cdf_sql(x: str) -> str:
    """cdf() of a column's name as SQL."""
    series, fraction = "1.0", f"abs({x})"
    for odd in range(LAST_ODD, 1, -2):
        series = f"(1 + {x} * {x} / {odd}.0 * {series})"
    for k in range(LEVELS, 0, -1):
        fraction = f"(abs({x}) + {k}.0 / {fraction})"
    tail = f"exp(-{x} * {x} / 2) / {ROOT!r} / {fraction}"
    return f"CASE WHEN abs({x}) < {SPLIT} THEN 0.5 + exp(-{x} * {x} / 2) / {ROOT!r} * {x} * {series} WHEN {x} < 0 THEN {tail} ELSE 1 - {tail} END"


def coint_z_sql(t: str) -> str:
    """The normal value whose cdf is the p-value of a statistic between the surface's ends, as SQL."""
    poly = lambda powers: " + ".join(f"{c!r} * power({t}, {k})" for k, c in enumerate(powers))
    return f"CASE WHEN {t} <= {COINT_SPLIT} THEN {poly(COINT_SMALL)} ELSE {poly(COINT_LARGE)} END"


def coint_pvalue_sql(t: str, z: str) -> str:
    """coint_pvalue() of a statistic's column and that of its coint_z_sql()."""
    return f"CASE WHEN {t} > {COINT_HIGH} THEN 1.0 WHEN {t} < {COINT_LOW} THEN 0.0 ELSE {cdf_sql(z)} END"


def inverse_sql(p: str) -> str:
    """inverse() of a column's name as SQL, by halving [-9, 9] instead of a formula."""
    return f"(WITH RECURSIVE h(n, lo, hi) AS (SELECT 0, -9.0::DOUBLE, 9.0::DOUBLE UNION ALL SELECT n + 1, CASE WHEN c < {p} THEN m ELSE lo END, CASE WHEN c < {p} THEN hi ELSE m END FROM (SELECT *, {cdf_sql('m')} AS c FROM (SELECT *, (lo + hi) / 2 AS m FROM h)) WHERE n < 60) SELECT lo FROM h WHERE n = 60)"
