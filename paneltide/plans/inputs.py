"""Panels, dimensions and trades derived from the driver's tables, with the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pairs, panels


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def brand(spark: SparkSession, d: str, unit: str = "week") -> DataFrame:
    """Mean price per piece of each brand and week or month; by day the mean price."""
    value = F.col("l_extendedprice") if unit == "day" else F.col("l_extendedprice") / F.col("l_quantity")
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    rows = read(spark, d, "lineitem").select("l_partkey", "l_shipdate", value.alias("v")).join(parts, "l_partkey")
    return rows.groupBy(F.to_date(F.date_trunc(unit, "l_shipdate")).alias("date"), "ticker").agg(F.avg("v").alias("px"))


def types(spark: SparkSession, d: str) -> DataFrame:
    """Mean price of each part type and day."""
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("ticker"))
    rows = read(spark, d, "lineitem").select("l_partkey", "l_shipdate", F.col("l_extendedprice").alias("v")).join(parts, "l_partkey")
    return rows.groupBy(F.to_date("l_shipdate").alias("date"), "ticker").agg(F.avg("v").alias("px"))


def placed(panel: DataFrame) -> DataFrame:
    return panel.join(F.broadcast(panels.positions(panel)), "ticker")


def aligned(spark: SparkSession, d: str, unit: str = "week") -> DataFrame:
    return pairs.align(placed(brand(spark, d, unit)))


def few(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of the six part types by day: fewer pairs, longer series."""
    return pairs.align(placed(types(spark, d)))


def trades(spark: SparkSession, d: str) -> DataFrame:
    """A trade for each order, made up from its columns."""
    o = read(spark, d, "orders")
    reasons = F.array(*[F.lit(x) for x in ("convergence", "max_holding", "stop_loss", "stop_loss_time", "regime_break")])
    held = (F.col("o_orderkey") % 20 + 1).cast("int")
    entry = F.to_date("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("trade_seq"),
        F.concat(F.lit("X"), F.col("o_custkey") % 7).alias("leg_x"),
        F.concat(F.lit("Y"), F.col("o_custkey") % 5).alias("leg_y"),
        F.col("o_orderpriority").alias("sector"),
        F.year("o_orderdate").alias("trading_year"),
        entry.alias("entry_date"),
        F.date_add(entry, held).alias("exit_date"),
        held.alias("holding_days"),
        F.round(F.col("o_totalprice") % 1000 - 480, 2).alias("pnl"),
        reasons[(F.col("o_orderkey") % 5).cast("int")].alias("exit_reason"),
    )


def sectors(spark: SparkSession, d: str) -> DataFrame:
    """A sector for most brands; every seventh has none."""
    n = F.regexp_extract("ticker", r"\d+", 0).cast("int")
    return read(spark, d, "part").select(F.col("p_brand").alias("ticker")).distinct().withColumn("sector", F.when(n % 7 != 0, F.concat(F.lit("S"), n % 4)))


_TRADES = """SELECT o_orderkey AS trade_seq, 'X' || (o_custkey % 7) AS leg_x, 'Y' || (o_custkey % 5) AS leg_y, o_orderpriority AS sector, CAST(year(o_orderdate) AS INT) AS trading_year,
  CAST(o_orderdate AS DATE) AS entry_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 20 + 1 AS INT) AS exit_date, CAST(o_orderkey % 20 + 1 AS INT) AS holding_days,
  round(o_totalprice % 1000 - 480, 2) AS pnl, ['convergence', 'max_holding', 'stop_loss', 'stop_loss_time', 'regime_break'][CAST(o_orderkey % 5 AS INT) + 1] AS exit_reason FROM orders"""


def panel_sql(unit: str) -> str:
    value = "l_extendedprice" if unit == "day" else "l_extendedprice / l_quantity"
    return f"SELECT CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS date, p_brand AS ticker, avg({value}) AS px FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"


_U = "u AS (SELECT ticker, CAST(row_number() OVER (ORDER BY ticker) - 1 AS INT) AS pos FROM (SELECT DISTINCT ticker FROM px))"
_AL = "al AS (SELECT a.ticker AS leg_x, b.ticker AS leg_y, a.date, a.px AS x, b.px AS y FROM px a JOIN px b ON a.date = b.date JOIN u ua ON a.ticker = ua.ticker JOIN u ub ON b.ticker = ub.ticker WHERE ua.pos < ub.pos)"
WEEK = f"WITH px AS ({panel_sql('week')}), {_U}, {_AL}"
MONTH = f"WITH px AS ({panel_sql('month')}), {_U}, {_AL}"
DAY = f"WITH px AS ({panel_sql('day')})"
TYPES = f"WITH px AS (SELECT CAST(l_shipdate AS DATE) AS date, p_type AS ticker, avg(l_extendedprice) AS px FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), {_U}, {_AL}"
#: hg: hedge of log prices; sp: the spread without the intercept.
SPREAD = """, hg AS (SELECT leg_x, leg_y, regr_slope(ln(x), ln(y)) AS hedge, regr_intercept(ln(x), ln(y)) AS intercept, regr_r2(ln(x), ln(y)) AS r2, count(*) AS n_obs FROM al GROUP BY ALL),
sp AS (SELECT al.*, ln(x) - hedge * ln(y) AS spread FROM al JOIN hg USING (leg_x, leg_y))"""
LAGGED = ", lg AS (SELECT *, spread AS s, lag(spread) OVER (PARTITION BY leg_x, leg_y ORDER BY date) AS lg FROM sp)"
TRADES = f"WITH t AS ({_TRADES})"
SECTORS = "sec AS (SELECT ticker, CASE WHEN n % 7 <> 0 THEN 'S' || (n % 4) END AS sector FROM (SELECT DISTINCT p_brand AS ticker, CAST(regexp_extract(p_brand, '\\d+') AS INT) AS n FROM part))"
