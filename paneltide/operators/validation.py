"""Stability of pairs, holding times, volatility look-ups and regimes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import estimators, panes
from .windows import BY, lag, zero_crossings


def parts(aligned: DataFrame, share: float = 0.75, by: tuple[str, ...] = BY) -> DataFrame:
    """Adds part: train for the first int(n * share) rows of a pair, val for the rest."""
    k = F.row_number().over(W.partitionBy(*by).orderBy("date"))
    n = F.count(F.lit(1)).over(W.partitionBy(*by))
    return aligned.withColumn("part", F.when(k <= F.floor(n * share), "train").otherwise("val"))


def estimates(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """hedge, t_stat and half_life (of the spread with intercept) of each group."""
    eg = estimators.engle_granger(rows, by=by)
    hl = estimators.half_life(estimators.spread(rows, eg, intercept=True, by=by), by=by).select(*by, "half_life")
    return eg.join(hl, list(by), "left")


def cointegrated(aligned: DataFrame, pvalue: float = 0.05, low: float = 5.0, high: float = 30.0, least: int = 60, by: tuple[str, ...] = BY) -> DataFrame:
    """The test that a pair must pass to be traded, with all that is known of its spread (less the intercept): hedge,
    intercept, r2, t_stat, pvalue, half_life, spread_mean, spread_std, spread_range, snr, crossing_rate, expected_holding,
    n_obs, and reason, the first gate that fails (null: none): rows, pvalue or half_life.

    Rows without both logarithms are none; a pair without `least` rows keeps its row, with its estimates null."""
    counted = aligned.groupBy(*by).agg(F.count(F.when((F.col("x") > 0) & (F.col("y") > 0), 1)).alias("n_rows"))
    eg = estimators.with_pvalue(estimators.engle_granger(aligned, by=by, least=least))
    rows = estimators.spread(aligned, eg, intercept=True, by=by).where("spread IS NOT NULL").select(*by, "date", "spread")
    out = counted.join(eg, list(by), "left").join(estimators.half_life(rows, by=by).select(*by, "half_life"), list(by), "left")
    out = out.join(estimators.spread_summary(rows, by=by), list(by), "left").join(estimators.snr(rows, by=by), list(by), "left")
    zero = zero_crossings(rows, by=by).select(*by, F.col("rate").alias("crossing_rate"), F.col("holding").alias("expected_holding"))
    reason = (
        F.when(F.col("n_rows") < least, "rows")
        .when(~F.coalesce(F.col("pvalue") <= pvalue, F.lit(False)), "pvalue")
        .when(~F.coalesce(F.col("half_life").between(low, high), F.lit(False)), "half_life")
    )
    names = ["hedge", "intercept", "r2", "t_stat", "pvalue", "half_life", "spread_mean", "spread_std", "spread_range", "snr", "crossing_rate", "expected_holding"]
    return out.join(zero, list(by), "left").select(*by, *names, F.col("n_rows").alias("n_obs"), reason.alias("reason"))


def stability(aligned: DataFrame, t_train: float, t_val: float, low: float = 5.0, high: float = 30.0, by: tuple[str, ...] = BY) -> DataFrame:
    """Both parts' estimates against each other: the ratios of half-lives and hedges, a score, and the first failed rule.

    t_train and t_val are the statistics of the p-values asked for; in the second part half-lives may be half and twice the bounds."""
    e = estimates(parts(aligned, by=by), (*by, "part"))
    side = lambda p: e.where(F.col("part") == p).select(*by, *[F.col(c).alias(f"{c}_{p}") for c in ("hedge", "t_stat", "half_life")])
    both = side("train").join(side("val"), list(by))
    both = both.withColumn("hl_ratio", F.col("half_life_val") / F.col("half_life_train")).withColumn("hedge_ratio", F.when(F.col("hedge_train") != 0, F.col("hedge_val") / F.col("hedge_train")))
    score = F.greatest(1 - (F.abs(F.col("hl_ratio") - 1) + F.abs(F.col("hedge_ratio") - 1)) / 2, F.lit(0.0))
    ok = lambda c: F.coalesce(c, F.lit(False))
    reason = (
        F.when(~ok((F.col("t_stat_train") <= t_train) & F.col("half_life_train").between(low, high)), "train")
        .when(~ok((F.col("t_stat_val") <= t_val) & F.col("half_life_val").between(low / 2, high * 2)), "validation")
        .when(~ok(F.col("hl_ratio").between(0.5, 2)), "half_life_ratio")
        .when(~ok(F.col("hedge_ratio").between(0.6, 1.67)), "hedge_ratio")
    )
    return both.withColumn("reason", reason).withColumn("score", F.when(F.col("reason").isNull(), score).otherwise(0.0))


def consistency(aligned: DataFrame, t_max: float, low: float, high: float, windows: int = 4, share: float = 0.6, least: int = 2, by: tuple[str, ...] = BY) -> DataFrame:
    """How many of a pair's overlapping windows pass, and 1 less the mean variation (population) of half-life and hedge among these."""
    e = panes.shares(aligned, windows, share, by=by)
    passed = F.coalesce((F.col("t_stat") <= t_max) & F.col("half_life").between(low, high), F.lit(False))
    own = lambda c: F.when(passed, F.col(c))
    cv = lambda c: F.stddev_pop(own(c)) / F.abs(F.avg(own(c)))
    m = e.groupBy(*by).agg(F.count(F.lit(1)).alias("n_windows"), F.sum(passed.cast("long")).alias("n_passed"), cv("half_life").alias("a"), cv("hedge").alias("b"))
    score = F.when(F.col("n_passed") >= least, F.greatest(1 - (F.col("a") + F.col("b")) / 2, F.lit(0.0))).when(F.col("n_passed") > 0, 0.5).otherwise(0.0)
    return m.select(*by, "n_windows", "n_passed", score.alias("score"))


def rolling_share(windows: DataFrame, t_max: float, max_half_life: float, by: tuple[str, ...] = BY) -> DataFrame:
    """The share of windows with a statistic that are significant and revert in time. windows: by..., t_stat, half_life."""
    good = F.coalesce((F.col("t_stat") < t_max) & (F.col("half_life") > 0) & (F.col("half_life") < max_half_life), F.lit(False))
    return windows.groupBy(*by).agg(F.count("t_stat").alias("n"), F.sum((good & F.col("t_stat").isNotNull()).cast("long")).alias("n_good")).withColumn("share", F.try_divide("n_good", "n"))


def rolling_reason(found: DataFrame, aligned: DataFrame, t_max: float, max_half_life: float, share: float, rows: int = 252, step: int = 63, by: tuple[str, ...] = BY) -> DataFrame:
    """found with rolling_reason: rolling_no_windows, rolling_consistency:<share>%<<asked>%, or null where enough windows
    of the pair pass. Only the pairs of found are tested."""
    some = aligned.join(found.select(*by), list(by), "left_semi")
    each = rolling_share(panes.rolling(some, rows, step, by=by), t_max, max_half_life, by).select(*by, F.col("n").alias("__n"), F.col("share").alias("__share"))
    percent = lambda x: F.concat(F.bround(x * 100, 0).cast("long").cast("string"), F.lit("%"))
    low = F.concat(F.lit("rolling_consistency:"), percent(F.col("__share")), F.lit("<"), percent(F.lit(share)))
    reason = F.when(F.coalesce(F.col("__n"), F.lit(0)) == 0, "rolling_no_windows").when(F.col("__share") < share, low)
    return found.join(each, list(by), "left").withColumn("rolling_reason", reason).drop("__n", "__share")


def adaptive_max_holding(recent: Column, formation: Column, multiple: float = 2.5, most: int = 45, weight: float = 0.5) -> Column:
    """Days to hold from a blend of recent and formation half-life; the recent one counts within 3..100."""
    blend = F.when(recent.between(3, 100), weight * recent + (1 - weight) * formation).otherwise(formation)
    return F.greatest(F.least(F.floor(multiple * blend), F.lit(most)), F.lit(5)).cast("int")


def vix_filter(dates: DataFrame, vix: DataFrame, threshold: float = 30.0, days: int = 5) -> DataFrame:
    """For each date the last known level, the mean of its last `days` values, and whether either exceeds the threshold."""
    mean = vix.withColumn("mean", F.avg("vix").over(W.orderBy("date").rowsBetween(1 - days, 0))).select(F.lit("v").alias("k"), "date", F.struct("vix", "mean").alias("v"))
    out = estimators.asof(dates.select(F.lit("v").alias("k"), "date"), mean, "v", ("k",))
    return out.select("date", F.col("v.vix").alias("vix"), F.col("v.mean").alias("mean"), F.coalesce((F.col("v.vix") > threshold) | (F.col("v.mean") > threshold), F.lit(False)).alias("high"))


def holding_times(series: DataFrame, value: str = "spread", by: tuple[str, ...] = BY) -> DataFrame:
    """Rows between successive crossings of a series' mean."""
    own = W.partitionBy(*by)
    s = series.where(F.col(value).isNotNull()).withColumn("__sign", F.when(F.col(value) - F.avg(value).over(own) < 0, -1).otherwise(1)).withColumn("__k", F.row_number().over(own.orderBy("date")))
    crossed = s.withColumn("__c", F.col("__sign") != lag("__sign", 1, by)).where("__c").select(*by, "date", "__k")
    return crossed.withColumn("holding", F.col("__k") - lag("__k", 1, by)).where("holding IS NOT NULL").select(*by, "date", "holding")


def holding_percentiles(series: DataFrame, value: str = "spread", by: tuple[str, ...] = BY) -> DataFrame:
    q = F.percentile("holding", F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    return holding_times(series, value, by).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("holding").alias("mean"), q.alias("percentiles"))


def bootstrap_holding(series: DataFrame, n: int = 1000, seed: int = 42, by: tuple[str, ...] = BY) -> DataFrame:
    """Mean, median and quartiles of the means of n resamples of each series' holding times."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = pdf.sort_values("date").holding.to_numpy(float)
        means = np.random.default_rng(seed).choice(h, (n, len(h))).mean(axis=1)
        row = {c: pdf[c].iloc[0] for c in by} | {"mean": means.mean(), "median": np.median(means), "p25": np.percentile(means, 25), "p75": np.percentile(means, 75)}
        return pd.DataFrame([row])

    return holding_times(series, by=by).groupBy(*by).applyInPandas(run, ", ".join(f"{c} string" for c in by) + ", mean double, median double, p25 double, p75 double")


def trend(panel: DataFrame, rows: int = 60, by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Adds trend: the price over that `rows` rows before, less 1."""
    return panel.withColumn("trend", F.try_divide(F.col("px"), lag("px", rows, by)) - 1)


def baskets(corr: DataFrame, universe: DataFrame, size: int, least: float) -> DataFrame:
    """Combinations of `size` tickers whose mean pairwise correlation reaches `least`: (members, mean_corr).

    A basket grows by tickers further on in the universe; sums of correlations that can no longer reach the bound are left out."""
    best, pairs_ = F.lit(1.0), size * (size - 1) // 2
    own = corr.select(F.col("leg_x").alias("a"), F.col("leg_y").alias("b"), F.col("corr").alias("c"))
    out = own.select(F.array("a", "b").alias("members"), F.col("b").alias("last"), F.col("c").alias("total"))
    for k in range(2, size):
        step = out.join(own, out["last"] == own["a"]).select("members", F.col("b").alias("last"), "total")
        linked = step.withColumn("m", F.explode("members")).join(own.select(F.col("a").alias("m"), F.col("b").alias("last"), "c"), ["m", "last"])
        out = linked.groupBy("members", "last", "total").agg(F.sum("c").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select(F.concat("members", F.array("last")).alias("members"), "last", (F.col("total") + F.col("s")).alias("total"))
        done = (k + 1) * k // 2
        out = out.where(F.col("total") + best * (pairs_ - done) >= least * pairs_)
    return out.select(F.concat_ws(",", "members").alias("members"), (F.col("total") / pairs_).alias("mean_corr"))


