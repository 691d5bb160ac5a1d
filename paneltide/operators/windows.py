"""Rolling and cumulative functions of a series. `by` names the columns of a series, rows are in the order of `order`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BY, ORDER = ("leg_x", "leg_y"), "date"


def frame(rows: int | None, by: tuple[str, ...] = BY, order: str = ORDER):
    """The last `rows` rows; all so far if None."""
    return W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding if rows is None else 1 - rows, 0)


def lag(c: str, n: int = 1, by: tuple[str, ...] = BY, order: str = ORDER) -> Column:
    return F.lag(c, n).over(W.partitionBy(*by).orderBy(order))


def diff(c: str, by: tuple[str, ...] = BY, order: str = ORDER) -> Column:
    return F.col(c) - lag(c, 1, by, order)


def zscore(df: DataFrame, value: str = "spread", lookback: int | None = 20, least: int | None = None, by: tuple[str, ...] = BY, order: str = ORDER) -> DataFrame:
    """Adds mu, sigma and z over the last `lookback` rows (None: all so far), null below `least` values or without spread."""
    w = frame(lookback, by, order)
    enough = F.count(value).over(w) >= (least if least is not None else lookback or 2)
    out = df.withColumn("mu", F.when(enough, F.avg(value).over(w))).withColumn("sigma", F.when(enough, F.stddev_samp(value).over(w)))
    return out.withColumn("z", F.when(F.col("sigma") > 0, (F.col(value) - F.col("mu")) / F.col("sigma")))


def adaptive_zscore(df: DataFrame, value: str, lookback: str, low: int, high: int, by: tuple[str, ...] = BY, order: str = ORDER) -> DataFrame:
    """As zscore with each row's own lookback of low..high rows and at least min(lookback, 30) values.

    Frames are literals in Spark: one collected frame of `high` rows serves all lookbacks in one window."""
    w = frame(high, by, order)
    held = df.withColumn("__all", F.collect_list(F.struct(F.col(value).alias("v"))).over(w))
    own = F.filter(F.transform(F.slice("__all", -F.least(F.col(lookback), F.size("__all")), F.least(F.col(lookback), F.size("__all"))), lambda s: s["v"]), lambda v: v.isNotNull())
    held = held.withColumn("__own", own).drop("__all")
    n = F.size("__own")
    mean = F.aggregate("__own", F.lit(0.0), lambda s, v: s + v) / n
    held = held.withColumn("mu", F.when(n >= F.least(F.col(lookback), F.lit(30)), F.when(n > 0, mean)))
    square = F.aggregate("__own", F.lit(0.0), lambda s, v: s + (v - F.col("mu")) * (v - F.col("mu")))
    held = held.withColumn("sigma", F.when(n > 1, F.sqrt(square / (n - 1))))
    return held.withColumn("z", F.when(F.col("sigma") > 0, (F.col(value) - F.col("mu")) / F.col("sigma"))).drop("__own")


def regime_flags(df: DataFrame, value: str = "spread", by: tuple[str, ...] = BY, order: str = ORDER) -> DataFrame:
    """Adds regime: 1 where the deviation of 20 rows exceeds 1.5 times that of 60."""
    deviation = lambda n, least: F.when(F.count(value).over(frame(n, by, order)) >= least, F.stddev_samp(value).over(frame(n, by, order)))
    return df.withColumn("regime", F.when(deviation(20, 10) > 1.5 * deviation(60, 30), 1).otherwise(0))


def rolling_correlation(df: DataFrame, rows: int, by: tuple[str, ...] = BY, order: str = ORDER) -> DataFrame:
    w = frame(rows, by, order)
    both = F.count(F.col("x") * F.col("y")).over(w)
    return df.withColumn("corr", F.when(both >= rows, F.corr("x", "y").over(w)))


def rolling_ols(df: DataFrame, rows: int, by: tuple[str, ...] = BY, order: str = ORDER) -> DataFrame:
    """Adds hedge: the slope of x on y over the last `rows` rows, null before."""
    w = frame(rows, by, order)
    return df.withColumn("hedge", F.when(F.count(F.lit(1)).over(w) >= rows, F.regr_slope("x", "y").over(w)))


def zero_crossings(df: DataFrame, value: str = "spread", lookback: int = 252, least: int = 30, by: tuple[str, ...] = BY, order: str = ORDER) -> DataFrame:
    """For each series: crossings of its mean in the last rows, their yearly rate, the expected holding (null: none)."""
    last = W.partitionBy(*by).orderBy(F.desc(order))
    tail = df.where(F.col(value).isNotNull()).withColumn("__n", F.row_number().over(last)).where(F.col("__n") <= lookback)
    signed = tail.withColumn("sign", F.when(F.col(value) - F.avg(value).over(W.partitionBy(*by)) < 0, -1).otherwise(1))
    moved = signed.withColumn("crossed", F.when(F.col("sign") != lag("sign", 1, by, order), 1).otherwise(0))
    out = moved.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("crossed").alias("crossings"))
    rate = F.when(F.col("n") >= least, F.col("crossings") * 252.0 / F.col("n")).otherwise(0.0)
    return out.withColumn("rate", rate).withColumn("holding", F.when((F.col("n") >= least) & (F.col("crossings") > 0), F.col("n") / (2.0 * F.col("crossings"))))


#: Numbers of the order column that one range of a running sum spans.
RANGE = 65_536


def drawdown(df: DataFrame, value: str = "pnl", by: tuple[str, ...] = (), order: str = "trade_seq", width: int = RANGE) -> DataFrame:
    """Adds cum and drawdown, the fall of the running sum below its highest so far. order: whole numbers, each once.

    The running sum is cut into ranges of the order. A range is known by its sum and its highest prefix, and those of the
    ranges before compose to where the next one starts; so a window holds the rows of one range, or a row for each range."""
    cut = df.withColumn("__range", F.floor(F.col(order) / width))
    inside = W.partitionBy(*by, "__range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    own = cut.withColumn("__cum", F.sum(value).over(inside)).withColumn("__top", F.max("__cum").over(inside))
    ranges = own.groupBy(*by, "__range").agg(F.max_by("__cum", order).alias("__sum"), F.max("__top").alias("__peak"))
    before = W.partitionBy(*(by or (F.lit(0),))).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.withColumn("__start", F.coalesce(F.sum("__sum").over(before), F.lit(0.0)))
    starts = starts.withColumn("__high", F.max(F.col("__start") + F.col("__peak")).over(before))
    keyed = starts.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__range").alias("__at"), "__start", "__high")
    same = F.col("__range") == F.col("__at")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = own.join(keyed, same).withColumn("cum", F.col("__start") + F.col("__cum"))
    out = out.withColumn("drawdown", F.greatest(F.col("__high"), F.col("__start") + F.col("__top")) - F.col("cum"))
    return out.select(*df.columns, "cum", "drawdown")


def percentile_below(df: DataFrame, value: str, rows: int, by: tuple[str, ...], order: str) -> DataFrame:
    """Adds share: of the last `rows` values (the current one too), those strictly below the current one."""
    w = frame(rows, by, order)
    held = F.collect_list(value).over(w)
    return df.withColumn("__held", held).withColumn("share", F.size(F.filter("__held", lambda v: v < F.col(value))) / F.size("__held")).drop("__held")


def normalised_range(aligned: DataFrame, rows: int = 252, least: int = 126) -> DataFrame:
    """For each pair: the range, in percent points, of the difference of both legs rebased to 100 at the window's start."""
    tail = aligned.withColumn("__n", F.row_number().over(W.partitionBy(*BY).orderBy(F.desc(ORDER)))).where(F.col("__n") <= rows)
    w = W.partitionBy(*BY).orderBy(ORDER).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    gap = tail.withColumn("gap", 100 * F.col("x") / F.first("x").over(w) - 100 * F.col("y") / F.first("y").over(w))
    return gap.groupBy(*BY).agg(F.count(F.lit(1)).alias("n"), (F.max("gap") - F.min("gap")).alias("range_pct")).withColumn("range_pct", F.when(F.col("n") >= least, F.col("range_pct")))


def month_windows(first, last, train: int = 12, test: int = 6, step: int | None = None) -> list[tuple]:
    """Half-open (id, train_start, train_end = test_start, test_end) that end by the last date."""
    import pandas as pd

    out, at, last = [], pd.Timestamp(first), pd.Timestamp(last)
    step = step or test
    while at + pd.DateOffset(months=train + test) <= last:
        mid = at + pd.DateOffset(months=train)
        out.append((len(out), at.date(), mid.date(), (mid + pd.DateOffset(months=test)).date()))
        at = at + pd.DateOffset(months=step)
    return out


def walk_forward(df: DataFrame, first, last, **how) -> DataFrame:
    """Rows with window_id and part (train or test) for each window that holds them; windows are a small dimension."""
    rows = month_windows(first, last, **how)
    dim = df.sparkSession.createDataFrame(rows, "window_id int, t0 date, t1 date, t2 date")
    joined = df.join(F.broadcast(dim), (F.col("date") >= F.col("t0")) & (F.col("date") < F.col("t2")))
    return joined.withColumn("part", F.when(F.col("date") < F.col("t1"), "train").otherwise("test")).drop("t0", "t1", "t2")


def ratio_split(df: DataFrame, ratio: float = 0.7, order: str = "date") -> DataFrame:
    """Adds part: train for the first int(n * ratio) dates, test for the rest. Ranks dates, a small dimension, not rows."""
    days = df.select(order).distinct()
    ranked = days.withColumn("__k", F.row_number().over(W.orderBy(order))).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy()))
    parts = ranked.select(order, F.when(F.col("__k") <= F.floor(F.col("__n") * ratio), "train").otherwise("test").alias("part"))
    return df.join(F.broadcast(parts), order)
