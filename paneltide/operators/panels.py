"""Long price panels: (date, ticker, px), their calendar, filters, fills and returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class PanelError(ValueError):
    """A panel that cannot be used: no such ticker, or nothing left."""


def sanitise(raw: DataFrame, order: str) -> DataFrame:
    """Of rows with the same date and ticker the first one in `order`; dates as DATE."""
    w = W.partitionBy("ticker", "date").orderBy(order)
    return raw.withColumn("date", F.col("date").try_cast("date")).where("date IS NOT NULL").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", order)


def positions(panel: DataFrame) -> DataFrame:
    """(ticker, pos): the place of each ticker by name. The universe is small; only it passes a single task."""
    return panel.select("ticker").distinct().withColumn("pos", F.row_number().over(W.orderBy("ticker")) - 1)


def select_tickers(panel: DataFrame, tickers: list[str], allow_missing: bool = False) -> DataFrame:
    """Rows of the tickers, whose names are trimmed and upper-cased, with their place in the request."""
    wanted = list(dict.fromkeys(t.strip().upper() for t in tickers))
    names = panel.sparkSession.createDataFrame([(t, i) for i, t in enumerate(wanted)], "ticker string, pos int")
    if not allow_missing:
        missing = [r[0] for r in names.join(panel.select("ticker").distinct(), "ticker", "left_anti").collect()]
        if missing:
            raise PanelError(f"no prices for {sorted(missing)}")
    return panel.join(F.broadcast(names), "ticker")


def drop_sparse(panel: DataFrame, min_prices: int) -> DataFrame:
    """Tickers with at least so many prices."""
    if min_prices <= 0:
        return panel
    kept = panel.groupBy("ticker").agg(F.count("px").alias("n")).where(F.col("n") >= min_prices).select("ticker")
    return panel.join(kept, "ticker", "left_semi")


def calendar(panel: DataFrame) -> DataFrame:
    return panel.select("date").distinct()


def quality(panel: DataFrame, min_prices: int, max_missing: float) -> DataFrame:
    """(ticker, n_prices, missing, passes) against the panel's calendar."""
    days = calendar(panel).agg(F.count(F.lit(1)).alias("n_days"))
    counts = panel.groupBy("ticker").agg(F.count("px").alias("n_prices"))
    out = counts.join(F.broadcast(days)).withColumn("missing", 1 - F.col("n_prices") / F.col("n_days"))
    return out.withColumn("passes", (F.col("n_prices") >= min_prices) & (F.col("missing") <= max_missing)).drop("n_days")


def complete(panel: DataFrame) -> DataFrame:
    """A row for each date and ticker, px null where there is none. Dates and tickers are dimensions of the panel."""
    names = panel.select("ticker").distinct()
    grid = names.join(F.broadcast(calendar(panel).agg(F.array_sort(F.collect_list("date")).alias("dates")))).select("ticker", F.explode("dates").alias("date"))
    return grid.join(panel, ["date", "ticker"], "left")


def fill(panel: DataFrame, column: str = "px", by: str = "ticker") -> DataFrame:
    """The last known value, or before any the first one."""
    back, ahead = W.partitionBy(by).orderBy("date").rowsBetween(W.unboundedPreceding, 0), W.partitionBy(by).orderBy("date").rowsBetween(0, W.unboundedFollowing)
    return panel.withColumn(column, F.coalesce(F.last(column, True).over(back), F.first(column, True).over(ahead)))


def fill_gaps(panel: DataFrame, most_missing: float = 0.20) -> DataFrame:
    """Where prices are missing: tickers that miss at most the share, filled; all tickers where none is missing."""
    full = complete(panel)
    share = full.groupBy("ticker").agg(F.avg(F.col("px").isNull().cast("int")).alias("missing"))
    return fill(full.join(share.where(F.col("missing") <= most_missing).select("ticker"), "ticker", "left_semi"))


def _lag(c: str | Column, by: list[str], n: int = 1) -> Column:
    return F.lag(c, n).over(W.partitionBy(*by).orderBy("date"))


def returns(panel: DataFrame, method: str = "log", by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Adds r: log returns of positive prices, or simple returns across gaps. The first row of a ticker has none."""
    if method == "log":
        value = F.when(F.col("px") > 0, F.log("px"))
        return panel.withColumn("r", value - _lag(value, list(by)))
    if method == "simple":
        w = W.partitionBy(*by).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
        held = panel.withColumn("__p", F.last("px", True).over(w))
        return held.withColumn("r", F.try_divide(F.col("__p"), _lag("__p", list(by))) - 1).drop("__p")
    raise ValueError(f"method must be log or simple, not {method}")


def last_dates(panel: DataFrame, n: int) -> DataFrame:
    """Rows of the panel's last n dates; all where n is not positive."""
    if n <= 0:
        return panel
    days = calendar(panel).orderBy(F.desc("date")).limit(n)
    return panel.join(F.broadcast(days), "date", "left_semi")


def years(panel: DataFrame, first: int, last: int) -> DataFrame:
    """Dates from the first to the last year, as a range so that row groups can be skipped."""
    return panel.where((F.col("date") >= F.make_date(F.lit(first), F.lit(1), F.lit(1))) & (F.col("date") < F.make_date(F.lit(last + 1), F.lit(1), F.lit(1))))


def validation_summary(panel: DataFrame, jump: float = 0.15) -> DataFrame:
    """For each ticker: days, missing share to four digits, days with a return beyond the jump, whether it has no price."""
    r = returns(complete(panel), "simple")
    return r.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.bround(F.avg(F.col("px").isNull().cast("double")), 4).alias("missing"),
        F.sum(F.when(F.abs("r") > jump, 1).otherwise(0)).alias("n_jumps"),
        (F.count("px") == 0).alias("empty"),
    )


def pivot(panel: DataFrame, tickers: list[str]) -> DataFrame:
    """Wide: a column for each ticker. The list is given, so no job runs to find it."""
    return panel.groupBy("date").pivot("ticker", tickers).agg(F.first("px", True))


def convert(panel: DataFrame, currency: DataFrame, rates: DataFrame) -> DataFrame:
    """Prices times the rate of their ticker's currency, known or last known; unknown currencies stay as they are.

    currency: (ticker, currency); rates: (date, currency, rate)."""
    days = calendar(panel).select("date")
    grid = fill(rates.select("currency").distinct().join(F.broadcast(days.agg(F.collect_list("date").alias("d")))).select("currency", F.explode("d").alias("date")).join(rates, ["date", "currency"], "left"), "rate", "currency")
    return panel.join(F.broadcast(currency), "ticker", "left").join(grid, ["date", "currency"], "left").withColumn("px", F.col("px") * F.coalesce("rate", F.lit(1.0))).drop("rate")
