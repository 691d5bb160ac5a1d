"""Combinatorially symmetric cross-validation and the probability of backtest overfitting.

Daily rows are read once, into sums by strategy and part; the splits then work on these sums alone."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def splits(spark: SparkSession, n: int) -> DataFrame:
    """(split, part, inside): every choice of half of the n parts, as bit masks."""
    if n % 2:
        raise ValueError("the number of parts must be even")
    masks = spark.range(1 << n).where(F.bit_count("id") == n // 2).select(F.col("id").alias("split"))
    parts = masks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return parts.withColumn("inside", F.expr("shiftright(split, part) & 1") == 1)


def part_sums(returns: DataFrame, n: int) -> DataFrame:
    """returns: (strategy, date, ret). n parts of equally many dates; those left over at the end are dropped."""
    days = returns.select("date").distinct()
    ranked = days.withColumn("k", F.row_number().over(W.orderBy("date")) - 1).withColumn("size", F.floor(F.count(F.lit(1)).over(W.partitionBy()) / n))
    dim = ranked.where(F.col("k") < F.col("size") * n).select("date", F.floor(F.col("k") / F.col("size")).cast("int").alias("part"))
    return returns.join(F.broadcast(dim), "date").groupBy("strategy", "part").agg(F.sum("ret").alias("total"), F.count(F.lit(1)).alias("n"))


def by_split(sums: DataFrame, n: int) -> DataFrame:
    """For each split: the best strategy inside (the first of equals), its means inside and outside, the median and rank outside."""
    choice = splits(sums.sparkSession, n)
    rows = sums.join(F.broadcast(choice), "part").groupBy("split", "strategy").agg(
        (F.sum(F.when(F.col("inside"), F.col("total"))) / F.sum(F.when(F.col("inside"), F.col("n")))).alias("is_mean"),
        (F.sum(F.when(~F.col("inside"), F.col("total"))) / F.sum(F.when(~F.col("inside"), F.col("n")))).alias("oos_mean"),
    )
    w = W.partitionBy("split")
    ranked = rows.withColumn("rank", F.rank().over(w.orderBy("oos_mean")) + (F.count(F.lit(1)).over(W.partitionBy("split", "oos_mean")) - 1) / 2)
    ranked = ranked.withColumn("n_strategies", F.count(F.lit(1)).over(w)).withColumn("median", F.median("oos_mean").over(w)).withColumn("first", F.row_number().over(w.orderBy(F.desc("is_mean"), "strategy")))
    share = F.least(F.greatest(F.col("rank") / F.col("n_strategies"), F.lit(0.01)), F.lit(0.99))
    return ranked.where("first = 1").select("split", "strategy", "is_mean", "oos_mean", "median", "rank", F.log(share / (1 - share)).alias("logit"), (F.col("oos_mean") < F.col("median")).alias("below"))


def analyse(returns: DataFrame, n: int = 16) -> DataFrame:
    """One row: strategies, combinations, pbo, mean inside and outside, degradation, rank correlation of the halves."""
    sums = part_sums(returns, n)
    of = by_split(sums, n)
    top = of.agg(F.count(F.lit(1)).alias("n_combinations"), F.avg(F.col("below").cast("double")).alias("pbo"), F.avg("is_mean").alias("is_mean"), F.avg("oos_mean").alias("oos_mean"), F.avg("logit").alias("mean_logit"))
    half = F.col("part") < n // 2
    halves = sums.groupBy("strategy").agg((F.sum(F.when(half, F.col("total"))) / F.sum(F.when(half, F.col("n")))).alias("a"), (F.sum(F.when(~half, F.col("total"))) / F.sum(F.when(~half, F.col("n")))).alias("b"))
    tied = lambda c: F.rank().over(W.orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(c)) - 1) / 2
    ranks = halves.select(tied("a").alias("ra"), tied("b").alias("rb")).agg(F.coalesce(F.corr("ra", "rb"), F.lit(0.0)).alias("rank_correlation"), F.count(F.lit(1)).alias("n_strategies"))
    out = top.join(F.broadcast(ranks))
    return out.withColumn("degradation", F.when(F.col("is_mean") != 0, (F.col("is_mean") - F.col("oos_mean")) / F.abs("is_mean")).otherwise(0.0))


def moments(returns: DataFrame) -> DataFrame:
    """Of each strategy: yearly Sharpe ratio, skewness and plain kurtosis (3 for a normal), for the deflated Sharpe ratio."""
    m = returns.groupBy("strategy").agg(F.avg("ret").alias("m"), F.stddev_pop("ret").alias("s"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurtosis"), F.count(F.lit(1)).alias("n"))
    return m.select("strategy", F.when(F.col("s") > 0, F.col("m") / F.col("s") * math.sqrt(252)).alias("sharpe"), "skew", "kurtosis", "n")


def best(moments: DataFrame) -> DataFrame:
    """The strategy of the highest Sharpe ratio (ties: the first name), and n_trials, how many there are. One row."""
    first = F.struct(-F.col("sharpe"), "strategy")
    return moments.where("sharpe IS NOT NULL").agg(F.min_by(F.struct("*"), first).alias("b"), F.count(F.lit(1)).alias("n_trials")).select("b.*", "n_trials")


def grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """All combinations of the axes' values, numbered in order, with a name `axis=value_axis=value`."""
    out = None
    for name, values in axes.items():
        dim = spark.createDataFrame([(v,) for v in values], [name])
        out = dim if out is None else out.crossJoin(F.broadcast(dim))
    label = F.concat_ws("_", *[F.concat(F.lit(f"{a}="), F.col(a).cast("string")) for a in axes])
    return out.withColumn("name", label)


def best_config(results: DataFrame, metric: str = "val_sharpe", least: int = 30) -> DataFrame:
    """The best of the configurations with enough trades that are not overfit; failing these, of all not overfit."""
    level = F.when(~F.col("overfit") & (F.col("val_trades") >= least), 2).when(~F.col("overfit"), 1).otherwise(0)
    return results.withColumn("__level", level).where("__level > 0").orderBy(F.desc("__level"), F.desc(metric), "name").limit(1).drop("__level")


def purged_walk_forward(returns: DataFrame, n_splits: int = 5, purge: int = 1, embargo: int = 1) -> DataFrame:
    """For each of n_splits later blocks: the mean return before it (less the purged and embargoed days) and in it."""
    days = returns.select("date").distinct().withColumn("k", F.row_number().over(W.orderBy("date")) - 1).withColumn("size", F.floor(F.count(F.lit(1)).over(W.partitionBy()) / (n_splits + 1)))
    daily = returns.groupBy("date").agg(F.avg("ret").alias("ret")).join(F.broadcast(days), "date")
    each = daily.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
    inside = (F.col("k") >= F.col("fold") * F.col("size")) & (F.col("k") < (F.col("fold") + 1) * F.col("size"))
    before = F.col("k") < F.col("fold") * F.col("size") - purge - embargo
    return each.groupBy("fold").agg(F.avg(F.when(before, F.col("ret"))).alias("is_mean"), F.avg(F.when(inside, F.col("ret"))).alias("oos_mean"))
