"""Column functions: returns, sizing, stops, scores, labels."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

GAMMA = 0.5772156649


def safe_log(x: Column) -> Column:
    """ln where positive, else null."""
    return F.when(x > 0, F.log(x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def adaptive_lookback(half_life: Column) -> Column:
    """int(4 * half-life) within 30..120."""
    return clamp(F.floor(4 * half_life), 30, 120).cast("int")


def vol_scaled_capital(base: Column, vol: Column, target: float = 0.02, low: float = 0.25, high: float = 2.0) -> Column:
    """Capital scaled to the target volatility; the base where the volatility is missing or not positive."""
    return F.when(vol.isNull() | F.isnan(vol) | (vol <= 0), base).otherwise(base * clamp(F.lit(target) / vol, low, high))


def safe_vol_scale(vol: Column, target: float = 0.02, low: float = 0.25, high: float = 2.0, floor: float = 0.003) -> Column:
    """The scale with the volatility floored; 1 where it is missing."""
    return F.when(vol.isNull() | F.isnan(vol), F.lit(1.0)).otherwise(clamp(F.lit(target) / F.greatest(vol, F.lit(floor)), low, high))


def time_based_stop(entry_z: Column, z: Column, holding: Column, half_life: Column, base: float, rate: float = 0.15) -> Column:
    """Whether a stop that tightens with each half-life held is hit. None before one half-life has passed."""
    level = F.greatest(base * (1 - rate * (holding / half_life - 1)), F.lit(1.5))
    return F.when(holding < half_life, F.lit(False)).when(entry_z < 0, z <= -level).otherwise(z >= level)


def johansen_score(trace: Column, critical: Column, rank: Column) -> Column:
    """How far the first trace statistic exceeds its critical value, times 1 + rank; 0 at rank 0."""
    return F.when(rank > 0, (trace - critical) / critical * (1 + rank)).otherwise(0.0)


def annualised_return(pnl: Column, capital: float = 50_000.0, years: float = 14.26) -> Column:
    """In percent; null where the capital is lost."""
    return F.when(1 + pnl / capital > 0, (F.pow(1 + pnl / capital, F.lit(1 / years)) - 1) * 100)


def overfit_risk(pbo: Column) -> Column:
    return F.when(pbo < 0.25, "Low").when(pbo < 0.5, "Moderate").when(pbo < 0.75, "High").otherwise("Severe")


def overfit(train_sharpe: Column, val_sharpe: Column, val_pnl: Column) -> Column:
    """A loss in validation, a Sharpe ratio over three times as high in training, or a high one there and a low one here."""
    ratio = F.when(val_sharpe != 0, train_sharpe / val_sharpe)
    return (val_pnl <= 0) | F.coalesce(ratio > 3, F.lit(False)) | ((val_sharpe < 0.3) & (train_sharpe > 1))


def pair_score(pvalue: Column, half_life: Column, range_: Column, hedge: Column, snr: Column, zcr: Column, stability: Column) -> Column:
    """The weighted score of a pair; each component lies in 0..1."""
    parts = [
        (0.20, F.least(-F.log(F.greatest(pvalue, F.lit(1e-10))) / 7, F.lit(1.0))),
        (0.15, F.greatest(F.lit(0.0), 1 - F.abs(half_life - 15) / 15)),
        (0.10, F.least(range_ / 0.10, F.lit(1.0))),
        (0.10, clamp(1 - F.abs(F.abs(hedge) - 1), 0.0, 1.0)),
        (0.15, F.least(snr / 3, F.lit(1.0))),
        (0.15, F.least(zcr / 20, F.lit(1.0))),
        (0.15, stability),
    ]
    total = F.lit(0.0)
    for weight, part in parts:
        total = total + weight * part
    return total


def one_digit(value: Column) -> Column:
    """The number with one digit, rounded as C and Python do: by its exact binary value, ties to the even digit.

    Spark's own format rounds the shortest decimal half up. Twenty times the fraction is taken as a sum and its exact
    error, so that it compares exactly with the odd number halfway between two digits."""
    x = F.abs(value)
    whole = F.floor(x)
    a, b = (x - whole) * 16, (x - whole) * 4
    s = a + b
    error = (a - (s - (s - a))) + (b - (s - a))
    digit = F.floor(s / 2)
    over = s - (digit * 2 + 1)
    up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & (digit % 2 == 1))))
    tenths = whole * 10 + digit + F.when(up, 1).otherwise(0)
    text = F.concat(F.when(value < 0, "-").otherwise(""), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    # Numbers of 2 ** 46 or more have few binary digits after the point or none; NaN keeps Spark's form.
    return F.when(x < 2.0**46, text).otherwise(F.format_string("%.1f", value))


def excluded_reason(pvalue: Column, half_life: Column, range_: Column, threshold: float, low: float, high: float, least: float) -> Column:
    """The first quality rule that fails, or null."""
    return (
        F.when(pvalue.isNull(), F.lit("pvalue:None"))
        .when(pvalue > threshold, F.concat(F.lit("pvalue:"), pvalue.cast("string")))
        .when(half_life.isNull(), F.lit("half_life:None"))
        .when(half_life < low, F.concat(F.lit("half_life_low:"), one_digit(half_life)))
        .when(half_life > high, F.concat(F.lit("half_life_high:"), one_digit(half_life)))
        .when(range_ < least, F.concat(F.lit("spread_range_low:"), one_digit(range_)))
    )


def regime(vix: Column) -> Column:
    """The volatility regime of a VIX level; a missing one counts as 20."""
    v = F.coalesce(vix, F.lit(20.0))
    return F.when(v > 30, "HIGH_VOL").when(v < 15, "LOW_VOL").otherwise("NORMAL")


def regime_score(vix: Column) -> Column:
    return F.when(vix.isNull(), 0.5).when(vix > 30, F.least(vix / 50, F.lit(1.0))).when(vix < 15, 0.2).otherwise((vix - 15) / 15)


def optimal_threshold(slippage_bps: float = 0.0) -> float:
    """The entry threshold in deviations that makes threshold times the chance of an entry largest, to four digits."""
    normal, cost = NormalDist(), slippage_bps / 1e4
    value = lambda d: (d - cost) * (1 - normal.cdf(d))
    low, high = 0.1, 3.0
    golden = (math.sqrt(5) - 1) / 2
    while high - low > 1e-9:
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (a, high) if value(a) < value(b) else (low, b)
    return round((low + high) / 2, 4)


def deflated_sharpe(sharpe: float, n_trials: int, skew: float = 0.0, kurtosis: float = 3.0, years: float = 1.0) -> tuple[float, float]:
    """The deflated Sharpe ratio and its p-value. With one trial nothing is deflated and the p-value is 0."""
    if n_trials <= 1:
        return sharpe, 0.0
    normal = NormalDist()
    expected = (1 - GAMMA) * normal.inv_cdf(1 - 1 / n_trials) + GAMMA * normal.inv_cdf(1 - 1 / (n_trials * math.e))
    periods = max(int(252 * years), 2)
    variance = (1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2) / (periods - 1)
    deviation = math.sqrt(max(variance, 1e-12))
    expected *= deviation
    z = (sharpe - expected) / deviation
    return z, 1 - normal.cdf(z)


def coint_pvalue(t: float) -> float:
    """MacKinnon's response surface for a residual test of two series with a constant."""
    if t > 0.92:
        return 1.0
    if t < -18.86:
        return 0.0
    coefficients = (2.92, 1.5012, 0.039796) if t <= -2.62 else (2.1945, 0.64695, -0.29198, -0.042377)
    return NormalDist().cdf(sum(c * t**k for k, c in enumerate(coefficients)))


def coint_threshold(pvalue: float) -> float:
    """The statistic whose p-value is the given one: filters on p become filters on t."""
    low, high = -18.0, 0.9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if coint_pvalue(mid) < pvalue else (low, mid)
    return (low + high) / 2


def coint_critical(n: int) -> tuple[float, float, float]:
    """Critical values at 1, 5 and 10 percent for n observations."""
    rows = ((-3.89644, -10.9519, -22.527), (-3.33613, -6.1101, -6.823), (-3.04445, -4.2412, -2.720))
    return tuple(a + b / n + c / n**2 for a, b, c in rows)
