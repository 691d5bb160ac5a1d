"""Selection of pairs in a formation year and trading in the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import estimators, pairs, panes, simulation, windows

BY = ("trading_year", "leg_x", "leg_y")


def formation(aligned: DataFrame) -> DataFrame:
    """aligned with the year that its date forms: all years are estimated in one plan."""
    return aligned.withColumn("trading_year", F.year("date") + 1)


def candidates(aligned: DataFrame, min_corr: float = -1.0, max_corr: float = 1.0) -> DataFrame:
    """Of each trading year and pair: correlation, Engle-Granger statistic, half-life, range, snr, crossing rate and score."""
    rows = formation(aligned)
    eg = panes.whole(rows, by=BY).withColumnRenamed("return_corr", "corr").where(F.col("corr").between(min_corr, max_corr)).drop("spread_mean")
    spread = estimators.spread(rows, eg, intercept=True, by=BY)
    keys = list(BY)
    ranges = spread.groupBy(*BY).agg((F.max("spread") - F.min("spread")).alias("spread_range"), F.avg("spread").alias("spread_mean"))
    out = eg.join(ranges, keys).join(windows.zero_crossings(spread, by=BY).select(*keys, F.col("rate").alias("zcr")), keys)
    p = estimators.with_pvalue(out)
    return p.withColumn("score", scalars.pair_score(F.col("pvalue"), F.coalesce("half_life", F.lit(1e9)), F.col("spread_range"), F.col("hedge"), F.col("snr"), F.col("zcr"), F.lit(1.0)))


def select(found: DataFrame, sectors: DataFrame, max_t: float = 0.0, half_lives: tuple[float, float] = (1.0, 100.0), hedges: tuple[float, float] = (0.0, 10.0), per_sector: int = 5, per_ticker: int = 2, most: int = 10) -> DataFrame:
    """The pairs traded in each year, with their rank. The filter on p is one on t (monotone), so it stays in Catalyst."""
    ok = found.where((F.col("t_stat") <= max_t) & F.col("half_life").between(*half_lives) & F.abs("hedge").between(*hedges))
    named = pairs.with_sectors(ok, sectors).withColumn("sector", F.coalesce("sector_x", F.lit("OTHER"))).drop("sector_x", "sector_y", "bucket")
    return pairs.greedy_diversified(named, ["trading_year"], per_sector, per_ticker, most)


def backtest(aligned: DataFrame, chosen: DataFrame, rules: simulation.Rules) -> DataFrame:
    """Trades of all years. Years are independent unless capital compounds from one to the next."""
    trading = aligned.withColumn("trading_year", F.year("date"))
    return simulation.simulate(simulation.prepare(trading, chosen, rules, ("trading_year",)), rules, ("trading_year",))


def backtest_sequential(aligned: DataFrame, chosen: DataFrame, rules: simulation.Rules, first: int, last: int) -> DataFrame:
    """Year by year, the capital of each carried to the next: what compounding needs. One number a year comes to the driver."""
    from dataclasses import replace

    out, capital = None, rules.capital
    for year in range(first, last + 1):
        own = backtest(aligned.where(F.year("date") == year), chosen.where(F.col("trading_year") == year), replace(rules, capital=capital))
        capital += own.agg(F.sum("pnl")).first()[0] or 0.0
        out = own if out is None else out.unionByName(own)
    return out
