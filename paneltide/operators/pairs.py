"""Pairs of tickers: enumeration, alignment, correlation and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def enumerate_pairs(universe: DataFrame) -> DataFrame:
    """All (x, y) with x before y by pos. universe: (ticker, pos), a dimension."""
    a = universe.select(F.col("ticker").alias("leg_x"), F.col("pos").alias("pos_x"))
    b = universe.select(F.col("ticker").alias("leg_y"), F.col("pos").alias("pos_y"))
    return a.join(F.broadcast(b), F.col("pos_x") < F.col("pos_y"))


def within_groups(universe: DataFrame, group: str) -> DataFrame:
    """Pairs of tickers of the same group."""
    a = universe.select(group, F.col("ticker").alias("leg_x"), F.col("pos").alias("pos_x"))
    b = universe.select(group, F.col("ticker").alias("leg_y"), F.col("pos").alias("pos_y"))
    return a.join(b, group).where("pos_x < pos_y")


def align(panel: DataFrame, value: str = "px") -> DataFrame:
    """(leg_x, leg_y, date, x, y) for pairs by pos and the dates that both have. panel: ticker, pos, date, value.

    The join is by date, which has as many rows as there are tickers on either side."""
    p = panel.where(F.col(value).isNotNull())
    a = p.select("date", F.col("ticker").alias("leg_x"), F.col("pos").alias("pos_x"), F.col(value).alias("x"))
    b = p.select("date", F.col("ticker").alias("leg_y"), F.col("pos").alias("pos_y"), F.col(value).alias("y"))
    return a.join(b, "date").where("pos_x < pos_y").select("leg_x", "leg_y", "date", "x", "y")


PAIR = ["leg_x", "leg_y"]


def correlation(aligned: DataFrame) -> DataFrame:
    """Pearson's correlation over the dates that both legs have."""
    return aligned.groupBy(*PAIR).agg(F.corr("x", "y").alias("corr"), F.count(F.lit(1)).alias("n_obs"))


def listwise(panel: DataFrame, value: str = "r") -> DataFrame:
    """Rows of the dates on which every ticker has a value."""
    n = panel.select(F.count_distinct("ticker").alias("n"))
    full = panel.groupBy("date").agg(F.count(value).alias("k")).join(F.broadcast(n)).where("k = n").select("date")
    return panel.join(full, "date", "left_semi")


def band(corr: DataFrame, low: float = 0.6, high: float = 0.99) -> DataFrame:
    return corr.where(F.col("corr").between(low, high))


def with_sectors(pairs: DataFrame, sectors: DataFrame) -> DataFrame:
    """Adds sector_x, sector_y and bucket (Same Sector, or Cross Sector where they differ or one is missing). sectors: a dimension."""
    sx = F.broadcast(sectors.select(F.col("ticker").alias("leg_x"), F.col("sector").alias("sector_x")))
    sy = F.broadcast(sectors.select(F.col("ticker").alias("leg_y"), F.col("sector").alias("sector_y")))
    out = pairs.join(sx, "leg_x", "left").join(sy, "leg_y", "left")
    return out.withColumn("bucket", F.when(F.col("sector_x") == F.col("sector_y"), "Same Sector").otherwise("Cross Sector"))


def bucket_summary(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_pairs"), *[F.bround(f("corr"), 3).alias(f"{n}_corr") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


def index_reason(pairs: DataFrame, tracks: DataFrame) -> DataFrame:
    """Adds reason `same_index:<index>` where both legs track one index, else null. tracks: (ticker, tracks_index)."""
    tx = F.broadcast(tracks.select(F.col("ticker").alias("leg_x"), F.col("tracks_index").alias("ix")))
    ty = F.broadcast(tracks.select(F.col("ticker").alias("leg_y"), F.col("tracks_index").alias("iy")))
    return pairs.join(tx, "leg_x", "left").join(ty, "leg_y", "left").withColumn("reason", F.when(F.col("ix") == F.col("iy"), F.concat(F.lit("same_index:"), "ix"))).drop("ix", "iy")


def correlation_reason(pairs: DataFrame, high: float) -> DataFrame:
    return pairs.withColumn("reason", F.when(F.col("corr") > high, F.format_string("high_corr:%.4f", "corr")))


def include_sectors(pairs: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Pairs with both legs in the included sectors and none in the excluded ones. Needs sector_x and sector_y."""
    out = pairs
    if exclude:
        out = out.where(~(F.coalesce(F.col("sector_x").isin(exclude), F.lit(False)) | F.coalesce(F.col("sector_y").isin(exclude), F.lit(False))))
    return out.where(F.col("sector_x").isin(include) & F.col("sector_y").isin(include)) if include else out


def without(pairs: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Pairs that are not on the list in either order."""
    key = [F.least("leg_x", "leg_y").alias("lo"), F.greatest("leg_x", "leg_y").alias("hi")]
    black = blacklist.select(*key).distinct()
    return pairs.select("*", *key).join(black, ["lo", "hi"], "left_anti").drop("lo", "hi")


def ranked(pairs: DataFrame, most: int) -> DataFrame:
    """By p-value (missing: 1) and then falling correlation; names break ties."""
    return pairs.orderBy(F.coalesce("pvalue", F.lit(1.0)), F.desc("corr"), "leg_x", "leg_y").limit(most)


def pair_counts(universe: DataFrame, group: str) -> DataFrame:
    return universe.groupBy(group).agg(F.count(F.lit(1)).alias("n")).select(group, (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n_pairs"))


def first_group(groups: DataFrame) -> DataFrame:
    """(ticker, sector): the first group in order that holds the ticker. groups: (ticker, sector, pos)."""
    return groups.groupBy("ticker").agg(F.min_by("sector", "pos").alias("sector"))


def greedy_diversified(ranked_pairs: DataFrame, key: list[str], per_sector: int, per_ticker: int, most: int) -> DataFrame:
    """The pairs that a walk by falling score (ties: leg_x, leg_y) takes within each group of key, if it takes a pair only
    while its sector and both tickers have places left, and `most` in all; with their rank. key and sector: no nulls.

    Pairs compete for places: a pair needs one of its sector and one of each leg. If among the open pairs of each of these
    it stands within the free places, no pair ahead can keep it out, and it is taken now, with all others of that kind;
    pairs that need a place of what is full go. The best open pair is always taken, so rounds end, and as a rule few are
    needed. The candidates and the rounds' tables are written to the checkpoint folder, once each."""
    names = [*key, "leg_x", "leg_y"]
    order = [F.desc("score"), "leg_x", "leg_y"]
    seats = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("name"), F.lit(cap).alias("cap")) for kind, c, cap in (("sector", "sector", per_sector), ("leg", "leg_x", per_ticker), ("leg", "leg_y", per_ticker))]))
    seat = [*key, "kind", "name"]
    needs = lambda rows: rows.select(*names, "score", seats.alias("seat")).select(*names, "score", "seat.*")
    every = cut(ranked_pairs)
    left = every.select(*names, F.col("sector").cast("string").alias("sector"), "score")
    taken = left.where("false")
    while not left.isEmpty():
        used = needs(taken).groupBy(*seat).agg(F.count(F.lit(1)).alias("used"))
        place = F.row_number().over(W.partitionBy(*seat).orderBy(*order))
        ahead = needs(left).withColumn("place", place).where(F.col("place") <= max(per_sector, per_ticker))
        fits = ahead.join(used, seat, "left").where(F.col("place") <= F.col("cap") - F.coalesce("used", F.lit(0)))
        now = fits.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n = 3").select(*names)
        taken = cut(taken.unionByName(left.join(now, names, "left_semi")))
        full = needs(taken).groupBy(*seat, "cap").agg(F.count(F.lit(1)).alias("used")).where("used >= cap").select(*seat)
        # Nothing behind the last of the first `most` can come in.
        last = taken.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= most)
        ends = last.where(F.col("rank") == most).select(*key, F.struct(-F.col("score"), "leg_x", "leg_y").alias("end"))
        shut = needs(left).join(full, seat).select(*names).distinct()
        rest = left.join(taken.select(*names), names, "left_anti").join(shut, names, "left_anti").join(ends, key, "left")
        left = cut(rest.where(F.col("end").isNull() | (F.struct(-F.col("score"), "leg_x", "leg_y") < F.col("end"))).drop("end"))
    chosen = taken.select(*names, F.row_number().over(W.partitionBy(*key).orderBy(*order)).cast("long").alias("rank")).where(F.col("rank") <= most)
    return every.join(chosen, names)


def best_per_sector(pairs: DataFrame, per_sector: int) -> DataFrame:
    w = W.partitionBy("sector").orderBy(F.desc("score"), "leg_x", "leg_y")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_sector)
