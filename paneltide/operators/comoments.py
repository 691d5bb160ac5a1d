"""Moments of all pairs of a panel from products of blocks, without a row for each pair and date.

Tickers are dealt to blocks by their position and dates to spans. The values of a block and span are packed into one row
of at most BLOCK x SPAN cells, and each pair of blocks of a span meets in one row, where the moments of all its pairs are a
few matrix products in numpy. Spark then adds the spans up by pair. Of N tickers and D dates, D x N x N / BLOCK cells are
shuffled and D / SPAN rows for each pair, in place of D rows for each pair.

Values are centred by their ticker's mean first, so that the products cancel little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, SPAN = 64, 128
SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def _matrix(cells: pa.ListScalar, block: int, span: int) -> np.ndarray:
    """days x places, NaN where there is no value."""
    out = np.full((span, block), np.nan)
    values = cells.values
    day, place, v = (values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    out[day, place] = v
    return out


def _products(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """SUMS of each column of x with each of y, over the days that both have."""
    has_x, has_y = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
    x, y = np.nan_to_num(x), np.nan_to_num(y)
    return [has_x.T @ has_y, x.T @ has_y, has_x.T @ y, (x * x).T @ has_y, has_x.T @ (y * y), x.T @ y]


def packed(panel: DataFrame, value: str, block: int, span: int) -> DataFrame:
    """block, span_no, cells: the centred values of a block's tickers in a span of days."""
    rows = panel.where(F.col(value).isNotNull() & ~F.isnan(value)).select("pos", "date", F.col(value).cast("double").alias("v"))
    centre = rows.groupBy("pos").agg(F.avg("v").alias("centre"))
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    cells = rows.join(centre, "pos").select(
        F.floor(F.col("pos") / block).cast("int").alias("block"),
        F.floor(day / span).cast("int").alias("span_no"),
        F.struct(F.pmod(day, F.lit(span)).cast("int").alias("day"), F.pmod("pos", F.lit(block)).cast("int").alias("place"), (F.col("v") - F.col("centre")).alias("v")).alias("cell"),
    )
    return cells.groupBy("block", "span_no").agg(F.collect_list("cell").alias("cells"))


def moments(panel: DataFrame, value: str = "px", block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """leg_x, leg_y and SUMS of the centred values, for pairs by pos that have a date in common.

    panel: ticker, pos (from 0 on, each ticker its own), date, value, one row a ticker and date."""
    rows = packed(panel, value, block, span)
    last = rows.agg(F.max("block").alias("last"))
    # Each pair of blocks is a key of its own, so a span's pairs spread over the cluster.
    spread = rows.join(F.broadcast(last))
    a = spread.select("span_no", F.col("block").alias("bx"), F.explode(F.sequence("block", "last")).alias("by"), F.col("cells").alias("x"))
    b = spread.select("span_no", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("bx"), F.col("block").alias("by"), F.col("cells").alias("y"))
    met = a.join(b, ["span_no", "bx", "by"]).select("bx", "by", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bx, by, x, y in zip(*(batch.column(k) for k in range(4)), strict=True):
                sums = _products(_matrix(x, block, span), _matrix(y, block, span))
                first, second = bx.as_py() * block, by.as_py() * block
                i, j = np.nonzero(sums[0])
                keep = first + i < second + j
                i, j = i[keep], j[keep]
                yield pa.RecordBatch.from_arrays([pa.array((first + i).astype(np.int32)), pa.array((second + j).astype(np.int32)), *[pa.array(s[i, j]) for s in sums]], names=["pos_x", "pos_y", *SUMS])

    parts = met.mapInArrow(run, "pos_x int, pos_y int, " + ", ".join(f"{s} double" for s in SUMS))
    total = parts.groupBy("pos_x", "pos_y").agg(*[F.sum(s).alias(s) for s in SUMS])
    names = panel.select("ticker", "pos").distinct()
    x, y = names.select(F.col("ticker").alias("leg_x"), F.col("pos").alias("pos_x")), names.select(F.col("ticker").alias("leg_y"), F.col("pos").alias("pos_y"))
    return total.join(x, "pos_x").join(y, "pos_y").select("leg_x", "leg_y", F.col("n").cast("long").alias("n"), *SUMS[1:])


def correlation(panel: DataFrame, value: str = "px", block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """leg_x, leg_y, corr (null where a leg doesn't vary over the common dates), n_obs."""
    c = F.col
    xx, yy, xy = c("sxx") - c("sx") * c("sx") / c("n"), c("syy") - c("sy") * c("sy") / c("n"), c("sxy") - c("sx") * c("sy") / c("n")
    # What is left of a constant after centring is rounding.
    varies = (xx > 1e-14 * c("sxx")) & (yy > 1e-14 * c("syy"))
    return moments(panel, value, block, span).select("leg_x", "leg_y", F.when(varies, xy / F.sqrt(xx * yy)).alias("corr"), c("n").alias("n_obs"))
