"""Estimators in closed form over moments: OLS hedge, half-life, Ornstein-Uhlenbeck, Engle-Granger, Johansen."""

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normal
from .windows import BY, ORDER, lag


def hedge(aligned: DataFrame, log: bool = True, by: tuple[str, ...] = BY, least: int = 30) -> DataFrame:
    """OLS of x on y with a constant: hedge, intercept, r2, n_obs; null below `least` rows."""
    v = (lambda c: F.when(F.col(c) > 0, F.log(c))) if log else F.col
    out = aligned.select(*by, v("x").alias("x"), v("y").alias("y")).groupBy(*by).agg(F.regr_slope("x", "y").alias("hedge"), F.regr_intercept("x", "y").alias("intercept"), F.regr_r2("x", "y").alias("r2"), F.regr_count("x", "y").alias("n_obs"))
    for c in ("hedge", "intercept", "r2"):
        out = out.withColumn(c, F.when(F.col("n_obs") >= least, F.col(c)))
    return out


def spread(aligned: DataFrame, hedges: DataFrame, log: bool = True, intercept: bool = False, by: tuple[str, ...] = BY) -> DataFrame:
    """Adds spread = x - hedge * y (less the intercept if asked), of log prices by default. hedges: one row for each pair."""
    v = (lambda c: F.when(F.col(c) > 0, F.log(c))) if log else F.col
    value = v("x") - F.col("hedge") * v("y") - (F.col("intercept") if intercept else F.lit(0.0))
    return aligned.join(hedges.select(*by, "hedge", "intercept"), list(by)).withColumn("spread", value)


def lagged(series: DataFrame, value: str = "spread", by: tuple[str, ...] = BY, order: str = ORDER) -> DataFrame:
    """Rows with s, lag and d = s - lag. Missing values are left out first, so gaps are bridged."""
    some = series.where(F.col(value).isNotNull()).select(*by, order, F.col(value).alias("s"))
    return some.withColumn("lag", lag("s", 1, by, order)).withColumn("d", F.col("s") - F.col("lag"))


def half_life_of(slope: Column) -> Column:
    """Of the slope of changes on levels; null unless the process reverts without alternating."""
    return F.when((slope < 0) & (1 + slope > 0), -math.log(2) / F.log(1 + slope))


def half_life(series: DataFrame, value: str = "spread", by: tuple[str, ...] = BY, order: str = ORDER, least: int = 30) -> DataFrame:
    """For each series: intercept, slope, phi, r2, n_obs, residual_std and half_life of the regression of changes on levels."""
    rows = lagged(series, value, by, order)
    m = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.regr_intercept("d", "lag").alias("intercept"),
        F.regr_slope("d", "lag").alias("slope"),
        F.regr_r2("d", "lag").alias("r2"),
        F.regr_count("d", "lag").alias("n_obs"),
        F.regr_syy("d", "lag").alias("syy"),
        F.regr_sxy("d", "lag").alias("sxy"),
    )
    ok = F.col("n_rows") >= least
    out = m.withColumn("phi", 1 + F.col("slope")).withColumn("residual_std", F.sqrt(F.greatest(F.try_divide(F.col("syy") - F.col("slope") * F.col("sxy"), F.col("n_obs") - 2), F.lit(0.0))))
    out = out.withColumn("half_life", half_life_of(F.col("slope")))
    return out.select(*by, *[F.when(ok, F.col(c)).alias(c) for c in ("intercept", "slope", "phi", "r2", "residual_std", "half_life")], "n_obs")


def recent_half_life(series: DataFrame, value: str = "spread", rows: int = 20, low: float = 1, high: float = 200, by: tuple[str, ...] = BY, order: str = ORDER) -> DataFrame:
    """half_life of each series' last rows, null outside low..high."""
    w = W.partitionBy(*by).orderBy(F.desc(order))
    tail = series.where(F.col(value).isNotNull()).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= rows)
    hl = half_life(tail, value, by, order, rows)
    return hl.select(*by, F.when(F.col("half_life").between(low, high), F.col("half_life")).alias("half_life"))


def ou(series: DataFrame, value: str = "spread", dt: float = 1.0, by: tuple[str, ...] = BY, order: str = ORDER, least: int = 30) -> DataFrame:
    """Ornstein-Uhlenbeck parameters by AR(1): theta, mu, sigma, half_life, beta, r2, n_obs; null where beta lies outside (0, 1)."""
    rows = lagged(series, value, by, order)
    m = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.regr_intercept("s", "lag").alias("alpha"),
        F.regr_slope("s", "lag").alias("beta"),
        F.regr_r2("s", "lag").alias("r2"),
        F.regr_count("s", "lag").alias("n_obs"),
        F.regr_syy("s", "lag").alias("syy"),
        F.regr_sxy("s", "lag").alias("sxy"),
    )
    ok = (F.col("n_rows") >= least) & (F.col("beta") > 0) & (F.col("beta") < 1)
    theta = -F.log(F.when(ok, F.col("beta"))) / dt
    residual = F.try_divide(F.col("syy") - F.col("beta") * F.col("sxy"), F.col("n_obs") - 2)
    out = m.withColumn("theta", theta).withColumn("mu", F.when(ok, F.col("alpha") / (1 - F.col("beta"))))
    out = out.withColumn("sigma", F.when(ok, F.sqrt(F.greatest(residual, F.lit(0.0)) * 2 * F.col("theta") / (1 - F.col("beta") * F.col("beta")))))
    return out.select(*by, "theta", "mu", "sigma", (math.log(2) / F.col("theta")).alias("half_life"), "beta", "r2", "n_obs")


def snr(series: DataFrame, value: str = "spread", by: tuple[str, ...] = BY, order: str = ORDER, least: int = 30) -> DataFrame:
    """Deviation of the levels over that of the changes; 0 below `least` rows or without changes."""
    m = lagged(series, value, by, order).groupBy(*by).agg(F.count("s").alias("n"), F.stddev_samp("s").alias("a"), F.stddev_samp("d").alias("b"))
    return m.select(*by, F.when((F.col("n") >= least) & (F.col("b") > 0), F.col("a") / F.col("b")).otherwise(0.0).alias("snr"))


def spread_summary(series: DataFrame, value: str = "spread", by: tuple[str, ...] = BY) -> DataFrame:
    return series.groupBy(*by).agg((F.max(value) - F.min(value)).alias("spread_range"), F.avg(value).alias("spread_mean"), F.stddev_samp(value).alias("spread_std"))


def engle_granger(aligned: DataFrame, log: bool = True, by: tuple[str, ...] = BY, least: int = 30) -> DataFrame:
    """Cointegration of x and y: hedge, n_obs, lag_used and t_stat of a residual test without constant, lag 0 or 1 by AIC.

    Two passes of moments: the regression of x on y, then, over the residuals and their two lags, the sums that both
    test regressions need. Perfectly collinear legs have no finite statistic (null)."""
    v = (lambda c: F.when(F.col(c) > 0, F.log(c))) if log else F.col
    rows = aligned.select(*by, ORDER, v("x").alias("x"), v("y").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    first = hedge(rows, False, by, least).where("hedge IS NOT NULL")
    resid = rows.join(first.select(*by, "hedge", "intercept"), list(by)).withColumn("e", F.col("x") - F.col("intercept") - F.col("hedge") * F.col("y"))
    r = resid.withColumn("e1", lag("e", 1, by)).withColumn("e2", lag("e", 2, by))
    d, d1 = F.col("e") - F.col("e1"), F.col("e1") - F.col("e2")
    r = r.select(*by, F.col("e1"), d.alias("d"), d1.alias("d1")).where("e1 IS NOT NULL")
    both = F.col("d1").isNotNull()
    total = lambda x, name: F.sum(x).alias(name)
    part = lambda x, name: F.sum(F.when(both, x)).alias(name)
    e1, d, d1 = F.col("e1"), F.col("d"), F.col("d1")
    m = r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n0"), total(e1 * e1, "a0"), total(e1 * d, "b0"), total(d * d, "c0"),
        F.count("d1").alias("n1"), part(e1 * e1, "a"), part(e1 * d, "b"), part(d * d, "c"), part(e1 * d1, "f"), part(d1 * d1, "g"), part(d * d1, "h"),
    )
    c = F.col
    det = c("a") * c("g") - c("f") * c("f")
    m = m.withColumn("det", det).withColumn("rho1", F.try_divide(c("b") * c("g") - c("h") * c("f"), c("det"))).withColumn("gam1", F.try_divide(c("a") * c("h") - c("f") * c("b"), c("det")))
    m = m.withColumn("ssr1", c("c") - c("rho1") * c("b") - c("gam1") * c("h")).withColumn("ssr0", c("c") - F.try_divide(c("b") * c("b"), c("a"))).withColumn("ssr", c("c0") - F.try_divide(c("b0") * c("b0"), c("a0")))
    aic = lambda s, k: F.when(c(s) > 0, c("n1") * F.log(c(s) / c("n1")) + 2 * k)
    m = m.withColumn("lag_used", F.when(aic("ssr1", 2) < aic("ssr0", 1), 1).otherwise(0))
    t0 = F.when(c("ssr") > 0, c("b0") / c("a0") / F.sqrt(c("ssr") / (c("n0") - 1) / c("a0")))
    t1 = F.when(c("ssr1") > 0, c("rho1") / F.sqrt(c("ssr1") / (c("n1") - 2) * c("g") / c("det")))
    m = m.withColumn("t_stat", F.when(c("lag_used") == 1, t1).otherwise(t0))
    return first.join(m.select(*by, "lag_used", "t_stat"), list(by)).select(*by, "hedge", "intercept", "r2", "n_obs", "lag_used", "t_stat")


def with_pvalue(rows: DataFrame, t: str = "t_stat", into: str = "pvalue") -> DataFrame:
    """Adds MacKinnon's p-value of t."""
    return rows.withColumn(into, normal.coint_pvalue(F.col(t)))


def trailing_hedge(aligned: DataFrame, lookback: int = 63, log: bool = True, by: tuple[str, ...] = BY) -> DataFrame:
    """OLS of x on y over each series' last `lookback` rows: date (its last), hedge, intercept, n_obs."""
    tail = aligned.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(ORDER)))).where(F.col("__n") <= lookback)
    v = (lambda c: F.when(F.col(c) > 0, F.log(c))) if log else F.col
    rows = tail.select(*by, ORDER, v("x").alias("x"), v("y").alias("y"))
    return rows.groupBy(*by).agg(F.max(ORDER).alias(ORDER), F.regr_slope("x", "y").alias("hedge"), F.regr_intercept("x", "y").alias("intercept"), F.regr_count("x", "y").alias("n_obs"))


def asof(left: DataFrame, right: DataFrame, value: str, by: tuple[str, ...] = BY) -> DataFrame:
    """left with the right's latest value by its date. One union and one window; no range join."""
    a = left.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__own", F.lit(1))
    b = right.select(*by, ORDER, F.col(value).alias("__v")).withColumn("__own", F.lit(0))
    w = W.partitionBy(*by).orderBy(ORDER, "__own").rowsBetween(W.unboundedPreceding, 0)
    return a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("__v", True).over(w)).where("__own = 1").drop("__v", "__own")


JOHANSEN_95 = (3.8415, 15.4943, 29.7961, 47.8545, 69.8189)
JOHANSEN_90 = (2.7055, 13.4294, 27.0669, 44.4929, 65.8202)
JOHANSEN_99 = (6.6349, 19.9349, 35.4628, 54.6815, 77.8202)


def johansen_of(prices):
    """Trace statistics, eigenvalues and first vector of a T x k array of log prices with a constant and one lagged change."""
    import numpy as np

    d = np.diff(prices, axis=0)
    lagged_, now, level = d[:-1], d[1:], prices[1:-1]
    demean = lambda a: a - a.mean(axis=0)
    lagged_, now, level = demean(lagged_), demean(now), demean(level)
    clear = lambda a: a - lagged_ @ np.linalg.lstsq(lagged_, a, rcond=None)[0]
    r0, r1 = clear(now), clear(level)
    n = len(r0)
    s00, s11, s01 = r0.T @ r0 / n, r1.T @ r1 / n, r0.T @ r1 / n
    values, vectors = np.linalg.eig(np.linalg.solve(s11, s01.T @ np.linalg.solve(s00, s01)))
    order = np.argsort(-values.real)
    values, vectors = np.clip(values.real[order], 0, 1 - 1e-12), vectors.real[:, order]
    trace = [-n * float(np.log(1 - values[i:]).sum()) for i in range(len(values))]
    first = vectors[:, 0] / vectors[0, 0]
    return trace, values.tolist(), first.tolist()


def johansen(baskets: DataFrame, log: bool = True) -> DataFrame:
    """baskets: (basket, date, ticker, pos, px), at most five tickers each. rank counts the trace statistics over their
    95 percent values; score compares the first with its own. A basket is one group: days times at most five."""
    import numpy as np

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="date", columns="pos", values="px").dropna()
        k = wide.shape[1]
        if k < 2 or len(wide) < 20 + 2 * k or (log and (wide.values <= 0).any()):
            return pd.DataFrame()
        trace, values, first = johansen_of(np.log(wide.values) if log else wide.values)
        critical = list(JOHANSEN_95[:k][::-1])
        rank = sum(t > c for t, c in zip(trace, critical, strict=True))
        score = (trace[0] - critical[0]) / critical[0] * (1 + rank) if rank else 0.0
        names = pdf.drop_duplicates("pos").sort_values("pos").ticker
        return pd.DataFrame([{"basket": pdf.basket.iloc[0], "tickers": ",".join(names), "basket_size": k, "cointegration_rank": rank, "score": score, "trace_stat_r0": trace[0], "crit_95_r0": critical[0], "eigenvalue_0": values[0], "hedge_ratios": [round(x, 4) for x in first]}])

    schema = "basket long, tickers string, basket_size int, cointegration_rank int, score double, trace_stat_r0 double, crit_95_r0 double, eigenvalue_0 double, hedge_ratios array<double>"
    return baskets.groupBy("basket").applyInPandas(run, schema)
