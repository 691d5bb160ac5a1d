"""Aggregates over trades: metrics, breakdowns, drawdown, blacklists, daily returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .windows import drawdown


def _when(cond, value=None):
    return F.sum(F.when(cond, F.lit(1) if value is None else value).otherwise(0 if value is None else 0.0))


def max_drawdown(trades: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The largest fall of the running profit below its highest, in the order of trade_seq."""
    rows = drawdown(trades, "pnl", by)
    return (rows.groupBy(*by) if by else rows.groupBy()).agg(F.max("drawdown").alias("max_drawdown"))


def metrics(trades: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Trades, wins, losses, profit, averages, profit factor (infinite without losses), drawdown, average holding."""
    win, loss = F.col("pnl") > 0, F.col("pnl") <= 0
    rows = drawdown(trades, "pnl", by)
    m = (rows.groupBy(*by) if by else rows.groupBy()).agg(
        F.count(F.lit(1)).alias("total_trades"),
        _when(win).alias("winning_trades"),
        _when(loss).alias("losing_trades"),
        F.sum("pnl").alias("total_pnl"),
        F.avg("pnl").alias("avg_pnl"),
        F.avg(F.when(win, F.col("pnl"))).alias("avg_winner"),
        F.avg(F.when(loss, F.col("pnl"))).alias("avg_loser"),
        _when(win, F.col("pnl")).alias("gross_profit"),
        (-_when(loss, F.col("pnl"))).alias("gross_loss"),
        F.max("drawdown").alias("max_drawdown"),
        F.avg("holding_days").alias("avg_holding_days"),
    )
    m = m.withColumn("win_rate", 100.0 * F.col("winning_trades") / F.col("total_trades"))
    factor = F.when(F.col("gross_loss") > 0, F.col("gross_profit") / F.col("gross_loss")).when(F.col("gross_profit") > 0, F.lit(float("inf"))).otherwise(0.0)
    return m.withColumn("profit_factor", factor).drop("gross_profit", "gross_loss")


def breakdown(trades: DataFrame, column: str) -> DataFrame:
    """Profit by exit reason, sector or another column."""
    return trades.groupBy(column).agg(F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("total_pnl"), F.avg("pnl").alias("avg_pnl"), (100.0 * _when(F.col("pnl") > 0) / F.count(F.lit(1))).alias("win_rate"))


REASONS = ["convergence", "max_holding", "period_end", "regime_break", "slow_convergence", "stop_loss", "stop_loss_time", "z_diverging"]


def yearly(trades: DataFrame, reasons: list[str] = REASONS) -> DataFrame:
    """A row for each year: trades, wins, profit and a count for each exit reason of the given list (in one pass)."""
    out = trades.groupBy("trading_year").agg(
        F.count_distinct("leg_x", "leg_y").alias("pairs"),
        F.count(F.lit(1)).alias("total_trades"),
        _when(F.col("pnl") > 0).alias("winning_trades"),
        F.sum("pnl").alias("total_pnl"),
        *[_when(F.col("exit_reason") == r).alias(f"{r}_exits") for r in reasons],
    )
    return out.withColumn("win_rate", 100.0 * F.col("winning_trades") / F.col("total_trades"))


def ending_capital(summary: DataFrame, initial: float = 50_000.0) -> DataFrame:
    """Adds the capital after each year. A row is a year."""
    return summary.withColumn("ending_capital", initial + F.sum("total_pnl").over(W.orderBy("trading_year").rowsBetween(W.unboundedPreceding, 0)))


def periods(summary: DataFrame, dim: DataFrame, capital: float) -> DataFrame:
    """Yearly summaries by period. dim: (period, first_year, last_year), a handful of rows."""
    rows = summary.join(F.broadcast(dim), F.col("trading_year").between(F.col("first_year"), F.col("last_year")))
    return rows.groupBy("period").agg(
        F.sum("total_pnl").alias("total_pnl"),
        F.sum("total_trades").alias("total_trades"),
        F.avg("win_rate").alias("win_rate"),
        _when(F.col("total_pnl") > 0).alias("profitable_years"),
        (F.avg("total_pnl") / capital * 100).alias("avg_return_pct"),
    )


def crisis_comparison(summary: DataFrame, crisis: tuple[int, ...], capital: float) -> DataFrame:
    kind = F.when(F.col("trading_year").isin(*crisis), "crisis").otherwise("normal")
    return summary.groupBy(kind.alias("regime")).agg(F.count(F.lit(1)).alias("years"), F.avg(F.col("total_pnl") / capital * 100).alias("mean_return_pct"), F.avg("win_rate").alias("mean_win_rate"))


def grid_averages(grid: DataFrame, axes: list[str], value: str = "total_pnl") -> DataFrame:
    """The mean by each axis on its own, all in one pass over the grid."""
    rows = grid.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("level"), F.col(value).alias("v")) for a in axes])).alias("r"))
    return rows.groupBy("r.axis", "r.level").agg(F.bround(F.avg("r.v"), 2).alias("mean"))


def pipeline_metrics(trades: DataFrame) -> DataFrame:
    """Sharpe ratio over trades (population deviation), and the profit factor with strict losses."""
    g, l = _when(F.col("pnl") > 0, F.col("pnl")), -_when(F.col("pnl") < 0, F.col("pnl"))
    m = trades.agg(F.avg("pnl").alias("m"), F.stddev_pop("pnl").alias("s"), g.alias("g"), l.alias("l"), F.sum("pnl").alias("total_pnl"), F.count(F.lit(1)).alias("n_trades"))
    return m.select("n_trades", "total_pnl", F.when(F.col("s") > 0, F.col("m") / F.col("s") * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe"), F.when(F.col("l") > 0, F.col("g") / F.col("l")).alias("profit_factor"))


def embargo(trades: DataFrame) -> DataFrame:
    """Days to embargo (mean holding) and purge (longest), at least one each."""
    held = F.when(F.col("holding_days") > 0, F.col("holding_days"))
    return trades.agg(F.greatest(F.coalesce(F.ceil(F.avg(held)), F.lit(1)), F.lit(1)).alias("embargo_days"), F.greatest(F.coalesce(F.ceil(F.max(held).cast("double")), F.lit(1)), F.lit(1)).alias("purge_days"))


def pair_performance(trades: DataFrame) -> DataFrame:
    m = trades.groupBy("leg_x", "leg_y").agg(F.sum("pnl").alias("total_pnl"), F.count(F.lit(1)).alias("n_trades"), F.avg("pnl").alias("avg_pnl"), F.stddev_samp("pnl").alias("pnl_std"), F.avg(F.when(F.col("exit_reason") == "convergence", 100.0).otherwise(0.0)).alias("convergence_pct"))
    return m.withColumn("sharpe", F.when(F.col("pnl_std") > 0, F.col("avg_pnl") / F.col("pnl_std")))


def blacklist(trades: DataFrame, least: int = 3, rate: float = 0.5) -> DataFrame:
    """For each pair and year the running trades and stop-losses, and whether the pair is barred from the next year on.

    Only the reason stop_loss counts; once barred, always barred."""
    by_year = trades.groupBy("leg_x", "leg_y", "trading_year").agg(F.count(F.lit(1)).alias("n"), _when(F.col("exit_reason") == "stop_loss").alias("s"))
    w = W.partitionBy("leg_x", "leg_y").orderBy("trading_year").rowsBetween(W.unboundedPreceding, 0)
    run = by_year.withColumn("trades", F.sum("n").over(w)).withColumn("stops", F.sum("s").over(w))
    over = (F.col("trades") >= least) & (F.col("stops") / F.col("trades") > rate)
    return run.withColumn("over", over).withColumn("barred", F.max("over").over(w)).select("leg_x", "leg_y", "trading_year", "trades", "stops", "barred")


#: Shares of a trade's profit as exact numbers, so that what comes in at entry goes out whole after exit.
EXACT = "decimal(38,18)"


def daily_pnl(trades: DataFrame, calendar: DataFrame, by: tuple[str, ...] = (), capital: float = 1.0) -> DataFrame:
    """Each trade's pnl / holding_days on every calendar date of [entry, exit], both ends included, and 0 on other dates.

    A trade is two events, its share at entry and less its share on the day after exit; they are added up by day, and one
    running sum over a strategy's days and the calendar's gives each date. A window holds days, never trades."""
    v = (F.col("pnl") / F.col("holding_days") / capital).cast(EXACT)
    held = trades.where((F.col("holding_days") > 0) & (F.col("entry_date") <= F.col("exit_date"))).select(*by, v.alias("v"), "entry_date", "exit_date")
    ends = F.array(F.struct(F.col("entry_date").alias("date"), F.col("v").alias("v")), F.struct(F.date_add("exit_date", 1).alias("date"), (-F.col("v")).alias("v")))
    events = held.select(*by, F.explode(ends).alias("e")).groupBy(*by, "e.date").agg(F.sum("e.v").alias("v"))
    days = calendar.select("date")
    if by:
        days = trades.select(*by).distinct().join(F.broadcast(days.agg(F.collect_list("date").alias("d")))).select(*by, F.explode("d").alias("date"))
    both = days.withColumns({"v": F.lit(None).cast(EXACT), "asked": F.lit(True)}).unionByName(events.select(*by, "date", F.col("v").cast(EXACT).alias("v"), F.lit(False).alias("asked")))
    w = W.partitionBy(*(by or (F.lit(0),))).orderBy("date").rangeBetween(W.unboundedPreceding, 0)
    return both.withColumn("ret", F.coalesce(F.sum("v").over(w), F.lit(0)).cast("double")).where("asked").select(*by, "date", "ret")


def extreme(trades: DataFrame, n: int, best: bool = True) -> DataFrame:
    return trades.orderBy(F.desc("pnl") if best else F.asc("pnl"), "trade_seq").limit(n)


def mixed(trades: DataFrame, reason: str, n: int) -> DataFrame:
    """Of a reason's trades the (n + 1) // 2 best and the rest worst."""
    own = trades.where(F.col("exit_reason") == reason)
    return extreme(own.where("pnl > 0"), (n + 1) // 2).unionByName(extreme(own.where("pnl <= 0"), n // 2, False))
