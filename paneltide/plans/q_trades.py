"""Queries: trades, cross-validation, scalar functions, filters, simulation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import normal
from ..functions import scalars as s
from ..operators import cscv, estimators, kalman, pairs, panels, signals, simulation, trades, windows
from . import inputs as i
from . import walkforward
from .registry import query, r6

T = i.TRADES
RUN = ", c AS (SELECT *, sum(pnl) OVER (ORDER BY trade_seq) AS cum FROM t), dd AS (SELECT *, max(cum) OVER (ORDER BY trade_seq) - cum AS drawdown FROM c)"
WIN = "count(*) FILTER (pnl > 0)"


@query("a5_trade_metrics", T + RUN + f" SELECT count(*) AS total_trades, {WIN} AS winning_trades, count(*) FILTER (pnl <= 0) AS losing_trades, round(sum(pnl), 4) AS total_pnl, round(avg(pnl), 6) AS avg_pnl, round(avg(pnl) FILTER (pnl > 0), 6) AS avg_winner, round(avg(pnl) FILTER (pnl <= 0), 6) AS avg_loser, round(max(drawdown), 4) AS max_drawdown, round(avg(holding_days), 6) AS avg_holding_days, round(100.0 * {WIN} / count(*), 6) AS win_rate, round(sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl <= 0), 6) AS profit_factor FROM dd")
def trade_metrics(spark, d):
    m = trades.metrics(i.trades(spark, d))
    return m.select("total_trades", F.col("winning_trades").cast("long"), F.col("losing_trades").cast("long"), F.round("total_pnl", 4).alias("total_pnl"), r6("avg_pnl"), r6("avg_winner"), r6("avg_loser"), F.round("max_drawdown", 4).alias("max_drawdown"), r6("avg_holding_days"), r6("win_rate"), r6("profit_factor"))


def _by(column):
    @query(f"{'a6_pnl_by_exit_reason' if column == 'exit_reason' else 'a7_pnl_by_sector'}", T + f" SELECT {column}, count(*) AS trades, round(sum(pnl), 4) AS total_pnl, round(avg(pnl), 6) AS avg_pnl, round(100.0 * {WIN} / count(*), 6) AS win_rate FROM t GROUP BY {column}")
    def _(spark, d):
        return trades.breakdown(i.trades(spark, d), column).select(column, "trades", F.round("total_pnl", 4).alias("total_pnl"), r6("avg_pnl"), r6("win_rate"))


_by("exit_reason")
_by("sector")

YEAR = ", y AS (SELECT trading_year, count(DISTINCT leg_x || leg_y) AS pairs, count(*) AS total_trades, " + WIN + " AS winning_trades, sum(pnl) AS total_pnl, 100.0 * " + WIN + " / count(*) AS win_rate" + "".join(f", count(*) FILTER (exit_reason = '{r}') AS {r}_exits" for r in trades.REASONS) + " FROM t GROUP BY trading_year)"


@query("a8_yearly_summary", T + YEAR + " SELECT * REPLACE (round(total_pnl, 4) AS total_pnl, round(win_rate, 6) AS win_rate), round(50000 + sum(total_pnl) OVER (ORDER BY trading_year), 3) AS ending_capital FROM y")
def _(spark, d):
    y = trades.ending_capital(trades.yearly(i.trades(spark, d)))
    return y.select(*[r6(c) if c == "win_rate" else F.round(c, 4).alias(c) if c == "total_pnl" else F.round(c, 3).alias(c) if c == "ending_capital" else c if c in ("trading_year", "pairs", "total_trades") else F.col(c).cast("long").alias(c) for c in y.columns])


@query("a9_period_analysis", T + YEAR + ", p(period, a, b) AS (VALUES ('early', 1995, 1997), ('late', 1998, 2001)) SELECT period, round(sum(total_pnl), 4) AS total_pnl, CAST(sum(total_trades) AS BIGINT) AS total_trades, round(avg(win_rate), 6) AS win_rate, count(*) FILTER (total_pnl > 0) AS profitable_years, round(avg(total_pnl) / 1000, 4) AS avg_return_pct FROM y JOIN p ON trading_year BETWEEN a AND b GROUP BY period")
def _(spark, d):
    dim = spark.createDataFrame([("early", 1995, 1997), ("late", 1998, 2001)], "period string, first_year int, last_year int")
    p = trades.periods(trades.yearly(i.trades(spark, d)), dim, 100_000.0)
    return p.select("period", F.round("total_pnl", 4).alias("total_pnl"), "total_trades", r6("win_rate"), F.col("profitable_years").cast("long"), F.round("avg_return_pct", 4).alias("avg_return_pct"))


@query("a10_crisis_comparison", T + YEAR + " SELECT CASE WHEN trading_year IN (1997, 1998) THEN 'crisis' ELSE 'normal' END AS regime, count(*) AS years, round(avg(total_pnl / 1000), 6) AS mean_return_pct, round(avg(win_rate), 6) AS mean_win_rate FROM y GROUP BY ALL")
def _(spark, d):
    return trades.crisis_comparison(trades.yearly(i.trades(spark, d)), (1997, 1998), 100_000.0).select("regime", "years", r6("mean_return_pct"), r6("mean_win_rate"))


@query("a11_grid_averages", T + ", g AS (SELECT holding_days % 3 AS a, trading_year % 2 AS b, sum(pnl) AS v FROM t GROUP BY ALL) SELECT 'a' AS axis, CAST(a AS DOUBLE) AS level, round(avg(v), 2) AS mean FROM g GROUP BY a UNION ALL SELECT 'b', CAST(b AS DOUBLE), round(avg(v), 2) FROM g GROUP BY b")
def _(spark, d):
    g = i.trades(spark, d).groupBy((F.col("holding_days") % 3).alias("a"), (F.col("trading_year") % 2).alias("b")).agg(F.sum("pnl").alias("total_pnl"))
    return trades.grid_averages(g, ["a", "b"])


@query("w9_drawdown", T + RUN + " SELECT trade_seq, round(cum, 4) AS cum, round(drawdown, 4) AS drawdown FROM dd")
def _(spark, d):
    return windows.drawdown(i.trades(spark, d)).select("trade_seq", F.round("cum", 4).alias("cum"), F.round("drawdown", 4).alias("drawdown"))


@query("a18_blacklist", T + ", y AS (SELECT leg_x, leg_y, trading_year, count(*) AS n, count(*) FILTER (exit_reason = 'stop_loss') AS s FROM t GROUP BY ALL), r AS (SELECT *, sum(n) OVER w AS nt, sum(s) OVER w AS ns FROM y WINDOW w AS (PARTITION BY leg_x, leg_y ORDER BY trading_year)) SELECT leg_x, leg_y, trading_year, CAST(nt AS BIGINT) AS trades, CAST(ns AS BIGINT) AS stops, max(nt >= 3 AND ns / nt > 0.21) OVER (PARTITION BY leg_x, leg_y ORDER BY trading_year) AS barred FROM r")
def _(spark, d):
    return trades.blacklist(i.trades(spark, d), 3, 0.21)


@query("a20_embargo", T + " SELECT CAST(ceil(avg(holding_days) FILTER (holding_days > 0)) AS BIGINT) AS embargo_days, CAST(max(holding_days) AS BIGINT) AS purge_days FROM t")
def _(spark, d):
    return trades.embargo(i.trades(spark, d))


@query("a21_pipeline_metrics", T + " SELECT count(*) AS n_trades, round(sum(pnl), 4) AS total_pnl, round(avg(pnl) / stddev_pop(pnl) * sqrt(252), 6) AS sharpe, round(sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl < 0), 6) AS profit_factor FROM t")
def _(spark, d):
    return trades.pipeline_metrics(i.trades(spark, d)).select("n_trades", F.round("total_pnl", 4).alias("total_pnl"), r6("sharpe"), r6("profit_factor"))


@query("a22_pair_performance", T + " SELECT leg_x, leg_y, round(sum(pnl), 4) AS total_pnl, count(*) AS n_trades, round(avg(pnl), 6) AS avg_pnl, round(stddev_samp(pnl), 6) AS pnl_std, round(avg(CASE WHEN exit_reason = 'convergence' THEN 100.0 ELSE 0.0 END), 6) AS convergence_pct, round(avg(pnl) / stddev_samp(pnl), 6) AS sharpe FROM t GROUP BY ALL")
def _(spark, d):
    return trades.pair_performance(i.trades(spark, d)).select("leg_x", "leg_y", F.round("total_pnl", 4).alias("total_pnl"), "n_trades", r6("avg_pnl"), r6("pnl_std"), r6("convergence_pct"), r6("sharpe"))


CAL = ", cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)"


@query("j7_daily_pnl", T + CAL + ", m AS (SELECT cal.date, sum(pnl / holding_days) AS v FROM cal JOIN t ON cal.date BETWEEN entry_date AND exit_date GROUP BY cal.date) SELECT cal.date, round(coalesce(v, 0.0), 8) AS ret FROM cal LEFT JOIN m ON m.date = cal.date", dates="date")
def _(spark, d):
    return trades.daily_pnl(i.trades(spark, d), panels.calendar(i.types(spark, d))).select("date", F.round("ret", 8).alias("ret"))


GRID = ", gt AS (SELECT 'C' || (trade_seq % 6) AS strategy, * FROM t), ds AS (SELECT DISTINCT strategy FROM gt), rm AS (SELECT ds.strategy, cal.date, coalesce(sum(pnl / holding_days / 50000.0), 0.0) AS ret FROM ds CROSS JOIN cal LEFT JOIN gt ON gt.strategy = ds.strategy AND cal.date BETWEEN entry_date AND exit_date GROUP BY ALL)"


def _returns(spark, d):
    g = i.trades(spark, d).withColumn("strategy", F.concat(F.lit("C"), F.col("trade_seq") % 6))
    return trades.daily_pnl(g, panels.calendar(i.types(spark, d)), ("strategy",), 50_000.0)


@query("x18_returns_matrix", T + CAL + GRID + " SELECT strategy, date, round(ret, 12) AS ret FROM rm", dates="date")
def _(spark, d):
    return _returns(spark, d).select("strategy", "date", F.round("ret", 12).alias("ret"))


CSCV = """, dy AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k, count(*) OVER () // 8 AS sz FROM cal),
ps AS (SELECT strategy, k // sz AS part, sum(ret) AS total, count(*) AS n FROM rm JOIN dy USING (date) WHERE k < sz * 8 GROUP BY ALL),
sp AS (SELECT i AS split, p AS part, (i >> p) & 1 = 1 AS inside FROM range(256) a(i), range(8) b(p) WHERE bit_count(CAST(i AS INT)) = 4),
r AS (SELECT split, strategy, sum(total) FILTER (inside) / sum(n) FILTER (inside) AS is_mean, sum(total) FILTER (NOT inside) / sum(n) FILTER (NOT inside) AS oos_mean FROM ps JOIN sp USING (part) GROUP BY ALL),
k AS (SELECT *, rank() OVER (PARTITION BY split ORDER BY oos_mean) + (count(*) OVER (PARTITION BY split, oos_mean) - 1) / 2 AS rk, count(*) OVER (PARTITION BY split) AS ns, median(oos_mean) OVER (PARTITION BY split) AS med, row_number() OVER (PARTITION BY split ORDER BY is_mean DESC, strategy) AS f FROM r),
b AS (SELECT *, ln(least(greatest(rk / ns, 0.01), 0.99) / (1 - least(greatest(rk / ns, 0.01), 0.99))) AS logit FROM k WHERE f = 1),
hv AS (SELECT strategy, sum(total) FILTER (part < 4) / sum(n) FILTER (part < 4) AS a, sum(total) FILTER (part >= 4) / sum(n) FILTER (part >= 4) AS b FROM ps GROUP BY strategy)"""


@query("x17_cscv_splits", T + CAL + GRID + CSCV + " SELECT split, strategy, round(is_mean, 10) AS is_mean, round(oos_mean, 10) AS oos_mean, round(rk, 1) AS \"rank\", round(logit, 6) AS logit, oos_mean < med AS below FROM b")
def cscv_splits(spark, d):
    return cscv.by_split(cscv.part_sums(_returns(spark, d), 8), 8).select("split", "strategy", F.round("is_mean", 10).alias("is_mean"), F.round("oos_mean", 10).alias("oos_mean"), F.round("rank", 1).alias("rank"), r6("logit"), "below")


@query("x17_cscv_pbo", T + CAL + GRID + CSCV + " SELECT count(*) AS n_combinations, round(avg((oos_mean < med)::INT), 6) AS pbo, round(avg(is_mean), 9) AS is_mean, round(avg(oos_mean), 9) AS oos_mean, round(avg(logit), 6) AS mean_logit, round((SELECT corr(ra, rb) FROM (SELECT rank() OVER (ORDER BY a) AS ra, rank() OVER (ORDER BY b) AS rb FROM hv)), 6) AS rank_correlation, (SELECT count(*) FROM hv) AS n_strategies, round((avg(is_mean) - avg(oos_mean)) / abs(avg(is_mean)), 6) AS degradation FROM b")
def cscv_pbo(spark, d):
    a = cscv.analyse(_returns(spark, d), 8)
    return a.select("n_combinations", r6("pbo"), F.round("is_mean", 9).alias("is_mean"), F.round("oos_mean", 9).alias("oos_mean"), r6("mean_logit"), r6("rank_correlation"), "n_strategies", r6("degradation"))


SHARPE = """, mo AS (SELECT strategy, avg(ret) AS m, stddev_pop(ret) AS s, count(*) AS n FROM rm GROUP BY strategy),
sk AS (SELECT strategy, any_value(m / s * sqrt(252)) AS sharpe, avg(power((ret - m) / s, 3)) AS skew, avg(power((ret - m) / s, 4)) AS kurtosis, any_value(n) AS n FROM rm JOIN mo USING (strategy) GROUP BY strategy)"""
DEFLATED = SHARPE + f""", be AS (SELECT *, (SELECT count(*) FROM sk) AS k FROM sk ORDER BY sharpe DESC, strategy LIMIT 1),
ps2 AS (SELECT *, 1 - 1 / k AS p1, 1 - 1 / (k * {math.e!r}) AS p2 FROM be),
iv AS (SELECT *, {normal.inverse_sql('p1')} AS i1, {normal.inverse_sql('p2')} AS i2 FROM ps2),
dv AS (SELECT *, sqrt(greatest((1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) / (greatest(floor(252 * (n / 252)), 2) - 1), 1e-12)) AS dev FROM iv),
dz AS (SELECT *, (sharpe - ({1 - normal.GAMMA!r} * i1 + {normal.GAMMA!r} * i2) * dev) / dev AS z FROM dv)"""


@query("f8_deflated_sharpe", T + CAL + GRID + DEFLATED + f" SELECT strategy, k AS n_trials, round(sharpe, 6) AS sharpe, round(z, 6) AS deflated, round(1 - ({normal.cdf_sql('z')}), 6) AS pvalue FROM dz")
def _(spark, d):
    best = cscv.best(cscv.moments(_returns(spark, d))).withColumn("years", F.col("n") / 252)
    return normal.with_deflated_sharpe(best).select("strategy", "n_trials", r6("sharpe"), r6("deflated"), r6("pvalue"))


@query("x20_sharpe_moments", T + CAL + GRID + SHARPE + " SELECT strategy, round(sharpe, 6) AS sharpe, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, n FROM sk")
def _(spark, d):
    return cscv.moments(_returns(spark, d)).select("strategy", r6("sharpe"), r6("skew"), r6("kurtosis"), "n")


@query("v9_purged_walk_forward", T + CAL + GRID + ", dy AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k, count(*) OVER () // 6 AS sz FROM cal), da AS (SELECT date, avg(ret) AS ret FROM rm GROUP BY date), e AS (SELECT f.f AS fold, da.ret, k, sz FROM da JOIN dy USING (date), range(1, 6) f(f)) SELECT fold, round(avg(ret) FILTER (k < fold * sz - 22), 9) AS is_mean, round(avg(ret) FILTER (k >= fold * sz AND k < (fold + 1) * sz), 9) AS oos_mean FROM e GROUP BY fold")
def _(spark, d):
    return cscv.purged_walk_forward(_returns(spark, d), 5, 20, 2).select(F.col("fold").cast("long").alias("fold"), F.round("is_mean", 9).alias("is_mean"), F.round("oos_mean", 9).alias("oos_mean"))


@query("u9_cscv_combinations", "SELECT i AS split, p AS part, (i >> p) & 1 = 1 AS inside FROM range(256) a(i), (SELECT CAST(p AS INT) AS p FROM range(8) b(p)) WHERE bit_count(CAST(i AS INT)) = 4")
def _(spark, d):
    return cscv.splits(spark, 8)


@query("u7_parameter_grid", "SELECT a AS entry, b AS hold, 'entry=' || a || '_hold=' || b AS name FROM (VALUES ('1.5'), ('2.0'), ('2.5')) x(a), (VALUES ('30'), ('60')) y(b)")
def _(spark, d):
    return cscv.grid(spark, {"entry": ["1.5", "2.0", "2.5"], "hold": ["30", "60"]})


@query("o4_best_config", T + f" SELECT exit_reason AS name, {WIN} AS val_trades, round(avg(pnl), 6) AS val_sharpe, false AS overfit FROM t GROUP BY exit_reason ORDER BY val_trades >= 30 DESC, val_sharpe DESC, name LIMIT 1")
def _(spark, d):
    c = i.trades(spark, d).groupBy(F.col("exit_reason").alias("name")).agg(F.sum(F.when(F.col("pnl") > 0, 1).otherwise(0)).alias("val_trades"), r6(F.avg("pnl"), "val_sharpe")).withColumn("overfit", F.lit(False))
    return cscv.best_config(c)


@query("o5_extreme_trades", T + " (SELECT trade_seq, pnl FROM t ORDER BY pnl DESC, trade_seq LIMIT 7) UNION ALL (SELECT trade_seq, pnl FROM t ORDER BY pnl, trade_seq LIMIT 7)")
def _(spark, d):
    t = i.trades(spark, d)
    return trades.extreme(t, 7).unionByName(trades.extreme(t, 7, False)).select("trade_seq", "pnl")


@query("p20_mixed_trades", T + ", o AS (SELECT trade_seq, pnl FROM t WHERE exit_reason = 'stop_loss') (SELECT * FROM o WHERE pnl > 0 ORDER BY pnl DESC, trade_seq LIMIT 4) UNION ALL (SELECT * FROM o WHERE pnl <= 0 ORDER BY pnl, trade_seq LIMIT 3)")
def _(spark, d):
    return trades.mixed(i.trades(spark, d), "stop_loss", 7).select("trade_seq", "pnl")


@query("r11_trades_of_a_year", T + " SELECT trade_seq, pnl FROM t WHERE year(entry_date) = 1998")
def _(spark, d):
    return i.trades(spark, d).where(F.year("entry_date") == 1998).select("trade_seq", "pnl")


# Scalar functions over rows of orders and lineitem.
S = "WITH v AS (SELECT o_orderkey AS k, o_totalprice % 97 AS a, o_totalprice % 13 AS b, o_totalprice % 1 AS f, CAST(o_orderkey % 40 AS INT) AS h FROM orders)"


def _v(spark, d):
    p = F.col("o_totalprice")
    return i.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (p % 97).alias("a"), (p % 13).alias("b"), (p % 1).alias("f"), (F.col("o_orderkey") % 40).cast("int").alias("h"))


@query("f3_adaptive_lookback", S + " SELECT k, CAST(least(greatest(floor(4 * a), 30), 120) AS INT) AS lookback FROM v")
def _(spark, d):
    return _v(spark, d).select("k", s.adaptive_lookback(F.col("a")).alias("lookback"))


@query("f4_volatility_sizing", S + " SELECT k, round(CASE WHEN f <= 0 THEN 10000.0 ELSE 10000.0 * least(greatest(0.02 / f, 0.25), 2.0) END, 6) AS capital, round(least(greatest(0.02 / greatest(f, 0.003), 0.25), 2.0), 6) AS scale FROM v")
def _(spark, d):
    return _v(spark, d).select("k", r6(s.vol_scaled_capital(F.lit(10_000.0), F.col("f")), "capital"), r6(s.safe_vol_scale(F.col("f")), "scale"))


@query("f6_time_based_stop", S + " SELECT k, CASE WHEN h < b + 1 THEN false WHEN f - 0.5 < 0 THEN (f - 0.5) * 8 <= -greatest(3.5 * (1 - 0.15 * (h / (b + 1) - 1)), 1.5) ELSE (f - 0.5) * 8 >= greatest(3.5 * (1 - 0.15 * (h / (b + 1) - 1)), 1.5) END AS stop FROM v")
def _(spark, d):
    z = F.col("f") - 0.5
    return _v(spark, d).select("k", s.time_based_stop(z, z * 8, F.col("h"), F.col("b") + 1, 3.5).alias("stop"))


@query("f12_market_regime", S + " SELECT k, CASE WHEN a > 30 THEN 'HIGH_VOL' WHEN a < 15 THEN 'LOW_VOL' ELSE 'NORMAL' END AS regime, round(CASE WHEN a > 30 THEN least(a / 50, 1.0) WHEN a < 15 THEN 0.2 ELSE (a - 15) / 15 END, 6) AS score FROM v")
def _(spark, d):
    return _v(spark, d).select("k", s.regime(F.col("a")).alias("regime"), r6(s.regime_score(F.col("a")), "score"))


@query("f19_overfit_flags", S + " SELECT k, (h - 20 <= 0) OR coalesce(CASE WHEN f <> 0 THEN b / f END > 3, false) OR (f < 0.3 AND b > 1) AS overfit, CASE WHEN f < 0.25 THEN 'Low' WHEN f < 0.5 THEN 'Moderate' WHEN f < 0.75 THEN 'High' ELSE 'Severe' END AS risk FROM v")
def _(spark, d):
    return _v(spark, d).select("k", s.overfit(F.col("b"), F.col("f"), F.col("h") - 20).alias("overfit"), s.overfit_risk(F.col("f")).alias("risk"))


@query("f20_annualised_return", S + " SELECT k, round((pow(1 + a * 100 / 50000.0, 1 / 14.26) - 1) * 100, 6) AS pct FROM v")
def _(spark, d):
    return _v(spark, d).select("k", r6(s.annualised_return(F.col("a") * 100), "pct"))


@query("f7_johansen_score", S + " SELECT k, round(CASE WHEN h % 4 > 0 THEN (a - 15.4943) / 15.4943 * (1 + h % 4) ELSE 0.0 END, 6) AS score FROM v")
def _(spark, d):
    return _v(spark, d).select("k", r6(s.johansen_score(F.col("a"), F.lit(15.4943), F.col("h") % 4), "score"))


@query("o2_pair_score", S + " SELECT k, round(0.20 * least(-ln(greatest(f, 1e-10)) / 7, 1.0) + 0.15 * greatest(0.0, 1 - abs(a - 15) / 15) + 0.10 * least(f / 0.10, 1.0) + 0.10 * least(greatest(1 - abs(abs(b - 6) - 1), 0.0), 1.0) + 0.15 * least(b / 3, 1.0) + 0.15 * least(h / 20, 1.0) + 0.15 * 1.0, 6) AS score FROM v")
def _(spark, d):
    c = F.col
    return _v(spark, d).select("k", r6(s.pair_score(c("f"), c("a"), c("f"), c("b") - 6, c("b"), c("h").cast("double"), F.lit(1.0)), "score"))


@query("p10_excluded_reasons", S + " SELECT k, CASE WHEN h % 9 = 0 THEN 'pvalue:None' WHEN h % 9 = 8 THEN 'pvalue:0.5' WHEN h % 7 = 0 THEN 'half_life:None' WHEN a < 5 THEN 'half_life_low:' || format('{:.1f}', a) WHEN a > 60 THEN 'half_life_high:' || format('{:.1f}', a) WHEN b < 4 THEN 'spread_range_low:' || format('{:.1f}', b) END AS reason FROM v")
def _(spark, d):
    v = _v(spark, d)
    p = F.when(F.col("h") % 9 == 0, None).when(F.col("h") % 9 == 8, 0.5).otherwise(0.01)
    return v.select("k", s.excluded_reason(p, F.when(F.col("h") % 7 != 0, F.col("a")), F.col("b"), 0.1, 5, 60, 4).alias("reason"))


@query("p12_selection_predicates", S + " SELECT k FROM v WHERE f >= 0.1 AND abs(b - 6) BETWEEN 0.5 AND 4 AND a >= 2 AND h >= 5")
def _(spark, d):
    return _v(spark, d).where((F.col("f") >= 0.1) & F.abs(F.col("b") - 6).between(0.5, 4) & (F.col("a") >= 2) & (F.col("h") >= 5)).select("k")


# What has no SQL: filters, state machines, eigenvalues, walks.
def _spread(spark, d):
    a = i.few(spark, d)
    return estimators.spread(a, estimators.hedge(a))


@query("k4_kalman_hedge")
def kalman_hedge(spark, d):
    return kalman.kalman_hedge(i.few(spark, d))


@query("k1_kalman_engine")
def _(spark, d):
    return kalman.kalman_engine(i.few(spark, d), momentum=False)


@query("k2_kalman_momentum")
def _(spark, d):
    return kalman.kalman_engine(i.few(spark, d))


@query("k5_kalman_regime")
def _(spark, d):
    return kalman.kalman_regime_hedge(windows.regime_flags(_spread(spark, d)))


@query("k6_kalman_ou")
def _(spark, d):
    return kalman.kalman_ou(_spread(spark, d))


def _signals(spark, d):
    return signals.signals(windows.zscore(_spread(spark, d), lookback=60, least=30), most_days=30)


@query("k7_position_signals")
def _(spark, d):
    return _signals(spark, d)


@query("a12_signal_summary")
def _(spark, d):
    return signals.summary(_signals(spark, d))


@query("x10_johansen_baskets")
def _(spark, d):
    p = i.placed(i.types(spark, d))
    baskets = p.withColumn("basket", F.explode(F.array(*[F.lit(k).cast("long") for k in range(20)])))
    from itertools import combinations

    dim = spark.createDataFrame([(k, pos) for k, c in enumerate(combinations(range(6), 3)) for pos in c], "basket long, pos int")
    return estimators.johansen(baskets.join(F.broadcast(dim), ["basket", "pos"]))


@query("k12_pair_selection")
def _(spark, d):
    sectors = panels.positions(i.brand(spark, d)).select("ticker", F.concat(F.lit("S"), F.col("pos") % 4).alias("sector"))
    return walkforward.select(walkforward.candidates(i.aligned(spark, d)), sectors, half_lives=(0.05, 100.0))


WALK = """, sc AS (SELECT CAST(year(date) AS INT) AS trading_year, leg_x, leg_y, round(abs(corr(x, y)), 4) AS score FROM al GROUP BY ALL HAVING count(*) > 5),
sr AS (SELECT sc.*, 'S' || (pos % 4) AS sector, row_number() OVER (PARTITION BY trading_year ORDER BY score DESC, leg_x, leg_y) AS rn FROM sc JOIN u ON ticker = leg_x WHERE score IS NOT NULL),
wk(trading_year, rn, legs, secs, hit) AS (SELECT DISTINCT trading_year, 0::BIGINT, []::VARCHAR[], []::VARCHAR[], false FROM sr UNION ALL
  SELECT trading_year, rn, CASE WHEN ok THEN list_concat(legs, [leg_x, leg_y]) ELSE legs END, CASE WHEN ok THEN list_append(secs, sector) ELSE secs END, ok FROM (
    SELECT sr.trading_year, sr.rn, legs, secs, leg_x, leg_y, sector, len(secs) < 12 AND len(list_filter(secs, lambda s: s = sector)) < 5 AND len(list_filter(legs, lambda s: s = leg_x)) < 2 AND len(list_filter(legs, lambda s: s = leg_y)) < 2 AS ok
    FROM wk JOIN sr ON sr.trading_year = wk.trading_year AND sr.rn = wk.rn + 1))"""


@query("w14_greedy", i.WEEK.replace("WITH", "WITH RECURSIVE", 1) + WALK + ' SELECT sr.trading_year, leg_x, leg_y, sector, score, len(secs) AS "rank" FROM wk JOIN sr ON sr.trading_year = wk.trading_year AND sr.rn = wk.rn WHERE hit')
def _(spark, d):
    """The twelve most correlated pairs of each year, five of a sector and two of a ticker at most."""
    a = i.aligned(spark, d).withColumn("trading_year", F.year("date"))
    each = a.groupBy("trading_year", *pairs.PAIR).agg(F.round(F.abs(F.corr("x", "y")), 4).alias("score"), F.count(F.lit(1)).alias("n")).where("n > 5 AND score IS NOT NULL").drop("n")
    sectors = panels.positions(i.brand(spark, d)).select(F.col("ticker").alias("leg_x"), F.concat(F.lit("S"), F.col("pos") % 4).alias("sector"))
    return pairs.greedy_diversified(each.join(sectors, "leg_x"), ["trading_year"], 5, 2, 12).select("trading_year", *pairs.PAIR, "sector", "score", "rank")


@query("k9_simulation")
def simulate(spark, d):
    a = i.few(spark, d)
    chosen = estimators.hedge(a).select(*pairs.PAIR, "hedge", F.lit(10.0).alias("half_life"), F.hash(*pairs.PAIR).alias("rank"))
    years = a.select(F.year("date").alias("trading_year")).distinct()
    return walkforward.backtest(a, chosen.join(F.broadcast(years.agg(F.collect_list("trading_year").alias("y")))).select(*pairs.PAIR, "hedge", "half_life", "rank", F.explode("y").alias("trading_year")), simulation.Rules(regime_break=False, max_holding_days=20))


@query("x14_nonparametric_threshold")
def _(spark, d):
    """For each pair the entry level, of 30, whose entries times profit are the most."""
    sp = windows.zscore(_spread(spark, d), lookback=None, least=20).select(*pairs.PAIR, "date", "z").where("z IS NOT NULL")
    levels = F.array(*[F.lit(0.3 + k * (2.5 - 0.3) / 29) for k in range(30)])
    each = sp.withColumn("prev", windows.lag("z")).select(*pairs.PAIR, "z", "prev", F.explode(levels).alias("level"))
    n = each.groupBy(*pairs.PAIR, "level").agg(F.sum(F.when((F.abs("z") >= F.col("level")) & (F.abs("prev") < F.col("level")), 1).otherwise(0)).alias("entries"))
    best = n.groupBy(*pairs.PAIR).agg(F.max_by("level", F.struct((2 * F.col("level") - 0.001) * F.col("entries"), -F.col("level"))).alias("level"))
    return best.select(*pairs.PAIR, F.round("level", 2).alias("level"))


@query("f14_optimal_threshold")
def _(spark, d):
    return spark.createDataFrame([(s.optimal_threshold(), math.log(2))], "threshold double, ln2 double")
