"""The pair scan: correlation, cointegration, ranking and every filter, as one table of kept and excluded pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import comoments, estimators, lookups, pairs, panels, panes, validation, windows
from ..session import cut


@dataclass(frozen=True)
class Scan:
    min_obs: int = 252
    min_corr: float = 0.6
    max_corr: float = 0.99
    lookback: int | None = 252
    max_pairs: int | str | None = None
    pvalue: float = 0.10
    min_half_life: float = 5.0
    max_half_life: float = 120.0
    min_range_pct: float = 0.0
    #: The share of rolling windows that must pass; None: they are not looked at.
    rolling_share: float | None = None
    rolling_rows: int = 252
    rolling_step: int = 63


def scan(panel: DataFrame, how: Scan, universe: str = "default", metadata: DataFrame | None = None) -> DataFrame:
    """Rows with the estimates and excluded_reason (null: kept). panel: date, ticker, px; metadata: ticker, sector, tracks_index.

    max_pairs (a number, or none or all) cuts the ranking before the filters; filters come in the order index, correlation,
    quality, rolling consistency. The last is over all dates of the panel, and only pairs that passed the others meet it."""
    rows = panels.last_dates(panel, how.lookback or 0)
    placed = rows.join(F.broadcast(panels.positions(rows)), "ticker")
    aligned = pairs.align(placed)
    corr = comoments.correlation(pairs.listwise(panels.returns(placed, "simple")), "r").drop("n_obs")
    # Both estimates below read the pairs.
    corr = cut(pairs.band(corr, how.min_corr, how.max_corr))
    some = aligned.join(corr.select(*pairs.PAIR), pairs.PAIR, "left_semi")
    eg = panes.whole(some).where(F.col("n_obs") >= min(how.min_obs, how.lookback or how.min_obs)).drop("snr", "return_corr")
    ranges = windows.normalised_range(some).select(*pairs.PAIR, F.col("range_pct").alias("spread_range_pct"))
    found = corr.join(estimators.with_pvalue(eg), pairs.PAIR).join(ranges, pairs.PAIR, "left")
    most = lookups.parse_max_pairs(how.max_pairs)
    if most is not None:
        found = pairs.ranked(found, most)
    quality = scalars.excluded_reason(F.col("pvalue"), F.col("half_life"), F.col("spread_range_pct"), how.pvalue, how.min_half_life, how.max_half_life, how.min_range_pct)
    out = pairs.correlation_reason(found, how.max_corr).withColumnRenamed("reason", "corr_reason")
    if metadata is not None:
        out = pairs.index_reason(out, metadata)
        sector = pairs.with_sectors(out, metadata)
        out = sector.where("sector_x = sector_y").drop("sector_x", "sector_y", "bucket")
    else:
        out = out.withColumn("reason", F.lit(None).cast("string"))
    reasons = F.coalesce("reason", "corr_reason", quality)
    if how.rolling_share is not None:
        out = cut(out.withColumn("reason", reasons))
        whole = pairs.align(panel.join(F.broadcast(panels.positions(panel)), "ticker"))
        t_max = scalars.coint_threshold(how.pvalue)
        rolled = validation.rolling_reason(out.where("reason IS NULL"), whole, t_max, how.max_half_life, how.rolling_share, how.rolling_rows, how.rolling_step)
        out = out.where("reason IS NOT NULL").withColumn("rolling_reason", F.lit(None).cast("string")).unionByName(rolled)
        reasons = F.coalesce("reason", "rolling_reason")
    return out.select(F.lit(universe).alias("universe"), *pairs.PAIR, F.col("corr").alias("correlation"), "n_obs", "spread_mean", "spread_std", F.col("hedge").alias("hedge_ratio"), F.col("t_stat").alias("coint_statistic"), F.col("pvalue").alias("coint_pvalue"), "half_life", "spread_range_pct", reasons.alias("excluded_reason"))


def rolling_scan(panel: DataFrame, rows: int = 252, step: int = 21, min_corr: float = 0.6, least_windows: int = 3) -> DataFrame:
    """For each pair correlated in price levels: windows, mean and deviation of the statistic, share at 10 percent, latest hedge."""
    placed = panel.join(F.broadcast(panels.positions(panel)), "ticker")
    aligned = pairs.align(placed)
    near = cut(comoments.correlation(placed).where(F.col("corr") >= min_corr).select(*pairs.PAIR))
    each = panes.rolling(aligned.join(near, pairs.PAIR, "left_semi"), rows, step)
    t10 = scalars.coint_threshold(0.10)
    return each.groupBy(*pairs.PAIR).agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.avg("t_stat").alias("mean_t"),
        F.stddev_samp("t_stat").alias("std_t"),
        F.avg((F.col("t_stat") < t10).cast("double")).alias("pct_significant"),
        F.avg("half_life").alias("mean_half_life"),
        F.stddev_samp("half_life").alias("std_half_life"),
        (F.stddev_samp("hedge") / F.abs(F.avg("hedge"))).alias("hedge_cv"),
        F.max_by("t_stat", "window").alias("latest_t"),
        F.max_by("hedge", "window").alias("latest_hedge"),
        F.max_by("half_life", "window").alias("latest_half_life"),
    ).where(F.col("n_windows") >= least_windows)


def tradeable(summary: DataFrame, pvalue: float = 0.10, share: float = 0.7, low: float = 5.0, high: float = 120.0) -> DataFrame:
    return summary.where((F.col("pct_significant") >= share) & (F.col("latest_t") < scalars.coint_threshold(pvalue)) & F.col("latest_half_life").between(low, high)).orderBy("latest_half_life")
