"""Queries: regions, sector members, windows by date."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups
from . import inputs as i
from .registry import query, r6

REGIONS = "WITH un AS (SELECT s_name AS ticker, n_name, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
RESULTS = "WITH rs AS (SELECT o_custkey AS leg_x, CAST(date_trunc('month', o_orderdate) AS DATE) AS window_date, max(o_totalprice % 97) AS half_life FROM orders GROUP BY ALL)"


def _results(spark, d):
    o = i.read(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("leg_x"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("window_date")).agg(F.max(F.col("o_totalprice") % 97).alias("half_life"))


@query("p16_region_filter", REGIONS + " SELECT ticker, region FROM un WHERE region IN ('ASIA', 'EUROPE', 'AFRICA') AND region <> 'AFRICA'")
def _(spark, d):
    n = i.read(spark, d, "nation").join(i.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    u = i.read(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("ticker"), F.col("r_name").alias("region"))
    return lookups.filter_regions(u, ["ASIA", "EUROPE", "AFRICA"], ["AFRICA"])


@query("f10_sector_members", f"WITH {i.SECTORS} SELECT DISTINCT ticker FROM sec WHERE sector = 'S1'")
def _(spark, d):
    return lookups.sector_members(i.sectors(spark, d), "S1")


@query("f11_all_sector_tickers", f"WITH {i.SECTORS} SELECT DISTINCT ticker FROM sec WHERE sector IS NOT NULL")
def _(spark, d):
    return lookups.sector_members(i.sectors(spark, d))


@query("j8_requested_windows", RESULTS + " SELECT leg_x, window_date, round(half_life, 6) AS half_life FROM rs WHERE window_date IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE month(l_shipdate) IN (3, 6))", dates="window_date")
def _(spark, d):
    wanted = i.read(spark, d, "lineitem").where(F.month("l_shipdate").isin(3, 6)).select(F.to_date("l_shipdate").alias("window_date")).distinct()
    return lookups.at_windows(_results(spark, d), wanted).select("leg_x", "window_date", r6("half_life"))


@query("j9_results_as_of", RESULTS + " SELECT leg_x, max(window_date) AS window_date, round(arg_max(half_life, window_date), 6) AS half_life FROM rs WHERE window_date <= DATE '1996-06-15' GROUP BY leg_x", dates="window_date")
def _(spark, d):
    return lookups.latest(_results(spark, d), ("leg_x",), "1996-06-15").select("leg_x", "window_date", r6("half_life"))


@query("w20_change_since_entry", i.TYPES + " SELECT ticker, date, round(px / first_value(px) OVER (PARTITION BY ticker ORDER BY date) - 1, 6) AS change FROM px", dates="date")
def _(spark, d):
    return lookups.change_since_entry(i.types(spark, d)).select("ticker", "date", r6("change"))


@query("f16_pair_names", i.TYPES + " SELECT DISTINCT leg_x, leg_y, leg_x || '_' || leg_y AS pair FROM al")
def _(spark, d):
    return i.few(spark, d).select("leg_x", "leg_y").distinct().withColumn("pair", lookups.pair_name())
