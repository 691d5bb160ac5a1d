"""Look-ups in dimensions and results: regions, sector members, windows by date, and what is written out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def filter_regions(universe: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """The rows of the regions asked for, without those left out; rows of no region stay only if none is asked for."""
    out = universe
    if include is not None:
        out = out.where(F.col("region").isin(list(include)))
    if exclude:
        out = out.where(~F.coalesce(F.col("region").isin(list(exclude)), F.lit(False)))
    return out


def sector_members(sectors: DataFrame, sector: str | None = None) -> DataFrame:
    """The distinct tickers of a sector (an unknown one has none), or of all sectors."""
    own = sectors.where("sector IS NOT NULL") if sector is None else sectors.where(F.col("sector") == sector)
    return own.select("ticker").distinct()


def at_windows(results: DataFrame, dates: DataFrame, column: str = "window_date") -> DataFrame:
    """The results of the window dates asked for; dates without a result give nothing."""
    return results.join(dates.select(column), column, "left_semi")


def latest(results: DataFrame, by: tuple[str, ...], as_of: str | None = None, column: str = "window_date", order: str = "half_life") -> DataFrame:
    """Of each key the row of its last window date, on as_of or before if that is given, by `order`, nulls last."""
    rows = results if as_of is None else results.where(F.col(column) <= F.to_date(F.lit(as_of)))
    rest = [c for c in results.columns if c not in by]
    best = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(column)).alias("__r"))
    return best.select(*by, *[F.col("__r")[c].alias(c) for c in rest]).orderBy(F.col(order).asc_nulls_last())


def change_since_entry(prices: DataFrame, value: str = "px", by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Adds change: the price over the first of its group, less 1."""
    first = F.first(value).over(W.partitionBy(*by).orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    return prices.withColumn("change", F.try_divide(F.col(value), first) - 1)


def pair_name(x: str | Column = "leg_x", y: str | Column = "leg_y") -> Column:
    return F.concat_ws("_", x, y)


def hedge_json(hedges: Column) -> Column:
    """Hedge ratios as a JSON list, rounded to four digits."""
    return F.to_json(F.transform(hedges, lambda h: F.round(h, 4)))


def parse_max_pairs(value: str | int | None) -> int | None:
    """How many pairs a scan keeps; none and all mean no bound."""
    return None if value is None or str(value).strip().lower() in ("", "none", "all") else int(value)


def nearest(asked: DataFrame, days: DataFrame, column: str = "q") -> DataFrame:
    """Each date of asked.column once, with the nearest date of days, however far; of two as near the earlier one.

    The last date before and the first after come from one window over both sets of distinct dates, which a calendar
    bounds (some 36,500 a century)."""
    both = asked.select(F.col(column).alias("__at"), F.lit(None).cast("date").alias("__day")).unionByName(days.select(F.col("date").alias("__at"), F.col("date").alias("__day")))
    each = both.where("__at IS NOT NULL").groupBy("__at").agg(F.max("__day").alias("__day"))
    w = W.orderBy("__at")
    near = each.withColumn("__before", F.last("__day", True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("__after", F.first("__day", True).over(w.rowsBetween(0, W.unboundedFollowing)))
    before = F.datediff("__at", "__before") <= F.datediff("__after", "__at")
    found = near.select(F.col("__at").alias(column), F.when(F.coalesce(before, F.col("__after").isNull()), F.col("__before")).otherwise(F.col("__after")).alias("date"))
    return asked.select(column).distinct().join(found, column)
