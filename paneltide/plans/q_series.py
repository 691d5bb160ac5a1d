"""Queries: windows, estimators and as-of joins over pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normal, scalars
from ..operators import estimators as e
from ..operators import pairs, panes
from ..operators import windows as w
from . import inputs as i
from .registry import query, r6

P = pairs.PAIR
T = i.TYPES + i.SPREAD
L = T + i.LAGGED
WB = "OVER (PARTITION BY leg_x, leg_y ORDER BY date"


def _rows(n):
    return f"{WB} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _spread(spark, d):
    a = i.few(spark, d)
    return e.spread(a, e.hedge(a))


@query("x8_hedge_ratio", T + " SELECT leg_x, leg_y, round(hedge, 6) AS hedge, round(intercept, 6) AS intercept, round(r2, 6) AS r2, n_obs FROM hg")
def _(spark, d):
    return e.hedge(i.few(spark, d)).select(*P, r6("hedge"), r6("intercept"), r6("r2"), "n_obs")


HALF = ", hl AS (SELECT leg_x, leg_y, regr_intercept(s - lg, lg) AS intercept, regr_slope(s - lg, lg) AS slope, regr_r2(s - lg, lg) AS r2, regr_syy(s - lg, lg) AS syy, regr_sxy(s - lg, lg) AS sxy, count(lg) AS n_obs FROM lg GROUP BY ALL)"


@query("x4_half_life", L + HALF + " SELECT leg_x, leg_y, round(intercept, 6) AS intercept, round(slope, 6) AS slope, round(1 + slope, 6) AS phi, round(r2, 6) AS r2, n_obs, round(sqrt((syy - slope * sxy) / (n_obs - 2)), 6) AS residual_std, round(CASE WHEN slope < 0 AND slope > -1 THEN -ln(2) / ln(1 + slope) END, 6) AS half_life FROM hl")
def _(spark, d):
    return e.half_life(_spread(spark, d)).select(*P, *[r6(c) for c in ("intercept", "slope", "phi", "r2")], "n_obs", r6("residual_std"), r6("half_life"))


@query("x3_half_life_tradeable", L + HALF + " SELECT leg_x, leg_y, coalesce(CASE WHEN slope < 0 AND slope > -1 THEN -ln(2) / ln(1 + slope) END BETWEEN 0.2 AND 5, false) AS tradeable FROM hl")
def _(spark, d):
    return e.half_life(_spread(spark, d)).select(*P, F.coalesce(F.col("half_life").between(0.2, 5), F.lit(False)).alias("tradeable"))


@query("x5_recent_half_life", T + ", tl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY leg_x, leg_y ORDER BY date DESC) AS n FROM sp) WHERE n <= 40), lg AS (SELECT *, spread AS s, lag(spread) OVER (PARTITION BY leg_x, leg_y ORDER BY date) AS lg FROM tl), q AS (SELECT leg_x, leg_y, regr_slope(s - lg, lg) AS b FROM lg GROUP BY ALL), h AS (SELECT leg_x, leg_y, CASE WHEN b < 0 AND b > -1 THEN -ln(2) / ln(1 + b) END AS h FROM q) SELECT leg_x, leg_y, round(CASE WHEN h BETWEEN 0.1 AND 200 THEN h END, 6) AS half_life FROM h")
def _(spark, d):
    return e.recent_half_life(_spread(spark, d), rows=40, low=0.1).select(*P, r6("half_life"))


@query("x6_ornstein_uhlenbeck", L + ", q AS (SELECT leg_x, leg_y, regr_intercept(s, lg) AS a, regr_slope(s, lg) AS b, regr_r2(s, lg) AS r2, count(lg) AS n_obs, regr_syy(s, lg) AS syy, regr_sxy(s, lg) AS sxy FROM lg GROUP BY ALL), k AS (SELECT *, CASE WHEN b > 0 AND b < 1 THEN b END AS ok FROM q) SELECT leg_x, leg_y, round(-ln(ok), 6) AS theta, round(a / (1 - ok), 6) AS mu, round(sqrt((syy - b * sxy) / (n_obs - 2) * 2 * -ln(ok) / (1 - ok * ok)), 6) AS sigma, round(ln(2) / -ln(ok), 6) AS half_life, round(b, 6) AS beta, round(r2, 6) AS r2, n_obs FROM k")
def _(spark, d):
    return e.ou(_spread(spark, d)).select(*P, *[r6(c) for c in ("theta", "mu", "sigma", "half_life", "beta", "r2")], "n_obs")


@query("a15_signal_to_noise", L + " SELECT leg_x, leg_y, round(stddev_samp(s) / stddev_samp(s - lg), 6) AS snr FROM lg GROUP BY ALL")
def _(spark, d):
    return e.snr(_spread(spark, d)).select(*P, r6("snr"))


@query("a16_spread_summary", T + " SELECT leg_x, leg_y, round(max(spread) - min(spread), 6) AS spread_range, round(avg(spread), 6) AS spread_mean, round(stddev_samp(spread), 6) AS spread_std FROM sp GROUP BY ALL")
def _(spark, d):
    return e.spread_summary(_spread(spark, d)).select(*P, *[r6(c) for c in ("spread_range", "spread_mean", "spread_std")])


EG = """, rs AS (SELECT al.leg_x, al.leg_y, date, ln(x) - intercept - hedge * ln(y) AS e FROM al JOIN hg USING (leg_x, leg_y)),
l0 AS (SELECT *, lag(e) OVER (PARTITION BY leg_x, leg_y ORDER BY date) AS e1, lag(e, 2) OVER (PARTITION BY leg_x, leg_y ORDER BY date) AS e2 FROM rs),
l1 AS (SELECT leg_x, leg_y, e1, e - e1 AS d, e1 - e2 AS d1 FROM l0 WHERE e1 IS NOT NULL),
m AS (SELECT leg_x, leg_y, count(*) AS n0, sum(e1 * e1) AS a0, sum(e1 * d) AS b0, sum(d * d) AS c0, count(d1) AS n1, sum(e1 * e1) FILTER (d1 IS NOT NULL) AS a, sum(e1 * d) FILTER (d1 IS NOT NULL) AS b, sum(d * d) FILTER (d1 IS NOT NULL) AS c, sum(e1 * d1) AS f, sum(d1 * d1) AS g, sum(d * d1) AS h FROM l1 GROUP BY ALL),
k AS (SELECT *, a * g - f * f AS det, (b * g - h * f) / (a * g - f * f) AS rho, (a * h - f * b) / (a * g - f * f) AS gam, c0 - b0 * b0 / a0 AS ssr, c - b * b / a AS ssr0 FROM m),
k1 AS (SELECT *, c - rho * b - gam * h AS ssr1 FROM k),
k2 AS (SELECT *, CASE WHEN n1 * ln(ssr1 / n1) + 4 < n1 * ln(ssr0 / n1) + 2 THEN 1 ELSE 0 END AS lag_used FROM k1),
eg AS (SELECT leg_x, leg_y, lag_used, CASE WHEN lag_used = 1 THEN rho / sqrt(ssr1 / (n1 - 2) * g / det) ELSE b0 / a0 / sqrt(ssr / (n0 - 1) / a0) END AS t_stat FROM k2)"""


@query("x1_engle_granger", T + EG + " SELECT leg_x, leg_y, round(hedge, 6) AS hedge, round(intercept, 6) AS intercept, round(r2, 6) AS r2, n_obs, lag_used, round(t_stat, 5) AS t_stat FROM hg JOIN eg USING (leg_x, leg_y)")
def _(spark, d):
    return e.engle_granger(i.few(spark, d)).select(*P, r6("hedge"), r6("intercept"), r6("r2"), "n_obs", "lag_used", F.round("t_stat", 5).alias("t_stat"))


@query("x1_engle_granger_all_brands", i.WEEK + i.SPREAD + EG + " SELECT leg_x, leg_y, round(hedge, 6) AS hedge, n_obs, lag_used, round(t_stat, 5) AS t_stat FROM hg JOIN eg USING (leg_x, leg_y)")
def engle_granger_all(spark, d):
    return e.engle_granger(i.aligned(spark, d)).select(*P, r6("hedge"), "n_obs", "lag_used", F.round("t_stat", 5).alias("t_stat"))


@query("x1_cointegrated_at", T + EG + f" SELECT leg_x, leg_y, t_stat <= {scalars.coint_threshold(0.05)!r} AS at5, t_stat <= {scalars.coint_threshold(0.01)!r} AS at1 FROM eg")
def _(spark, d):
    return e.engle_granger(i.few(spark, d)).select(*P, (F.col("t_stat") <= scalars.coint_threshold(0.05)).alias("at5"), (F.col("t_stat") <= scalars.coint_threshold(0.01)).alias("at1"))


PV = f", pz AS (SELECT *, {normal.coint_z_sql('t_stat')} AS z FROM eg), pv AS (SELECT leg_x, leg_y, lag_used, t_stat, {normal.coint_pvalue_sql('t_stat', 'z')} AS pvalue FROM pz)"


@query("x1_pvalue", T + EG + PV + " SELECT leg_x, leg_y, round(t_stat, 5) AS t_stat, round(pvalue, 7) AS pvalue FROM pv")
def _(spark, d):
    return e.with_pvalue(e.engle_granger(i.few(spark, d))).select(*P, F.round("t_stat", 5).alias("t_stat"), F.round("pvalue", 7).alias("pvalue"))


@query("o1_pair_ranking", i.WEEK + i.SPREAD + EG + PV + ", c AS (SELECT leg_x, leg_y, round(corr(x, y), 6) AS corr FROM al GROUP BY ALL) SELECT leg_x, leg_y, round(pvalue, 9) AS pvalue, round(t_stat, 5) AS t_stat, corr FROM pv JOIN c USING (leg_x, leg_y) ORDER BY round(pvalue, 9), corr DESC, leg_x, leg_y LIMIT 20")
def _(spark, d):
    a = i.aligned(spark, d)
    rows = e.with_pvalue(e.engle_granger(a)).withColumn("pvalue", F.round("pvalue", 9)).join(pairs.correlation(a).select(*P, r6("corr")), P)
    return pairs.ranked(rows, 20).select(*P, "pvalue", F.round("t_stat", 5).alias("t_stat"), "corr")


@query("w1_lag_and_change", L + " SELECT leg_x, leg_y, date, round(s, 6) AS s, round(lg, 6) AS lag, round(s - lg, 6) AS d FROM lg", dates="date")
def _(spark, d):
    return e.lagged(_spread(spark, d)).select(*P, "date", r6("s"), r6("lag"), r6("d"))


def _z(n, least):
    return f" SELECT leg_x, leg_y, date, round(CASE WHEN count(spread) {_rows(n)} >= {least} AND stddev_samp(spread) {_rows(n)} > 0 THEN (spread - avg(spread) {_rows(n)}) / stddev_samp(spread) {_rows(n)} END, 6) + 0.0 AS z FROM sp"


@query("w2_rolling_zscore", T + _z(20, 20), dates="date")
def _(spark, d):
    return w.zscore(_spread(spark, d), lookback=20).select(*P, "date", r6("z"))


@query("w3_engine_zscore", T + _z(60, 30), dates="date")
def zscores(spark, d):
    return w.zscore(_spread(spark, d), lookback=60, least=30).select(*P, "date", r6("z"))


@query("w2_expanding_zscore", T + f" SELECT leg_x, leg_y, date, round(CASE WHEN count(spread) {WB}) >= 20 THEN (spread - avg(spread) {WB})) / stddev_samp(spread) {WB}) END, 6) + 0.0 AS z FROM sp", dates="date")
def _(spark, d):
    return w.zscore(_spread(spark, d), lookback=None, least=20).select(*P, "date", r6("z"))


@query("w4_adaptive_zscore", T + ", lb AS (SELECT *, CAST(30 + (length(leg_x) * 7 + length(leg_y)) % 30 AS INT) AS n, row_number() OVER (PARTITION BY leg_x, leg_y ORDER BY date) AS rn FROM sp), q AS (SELECT a.leg_x, a.leg_y, a.date, a.spread, avg(b.spread) AS mu, stddev_samp(b.spread) AS sd, count(b.spread) AS c FROM lb a JOIN lb b ON a.leg_x = b.leg_x AND a.leg_y = b.leg_y AND b.rn BETWEEN a.rn - a.n + 1 AND a.rn GROUP BY ALL) SELECT leg_x, leg_y, date, round(CASE WHEN c >= 30 AND sd > 0 THEN (spread - mu) / sd END, 6) AS z FROM q", dates="date")
def _(spark, d):
    s = _spread(spark, d).withColumn("n", (30 + (F.length("leg_x") * 7 + F.length("leg_y")) % 30).cast("int"))
    return w.adaptive_zscore(s, "spread", "n", 30, 60).select(*P, "date", r6("z"))


@query("w5_regime_flags", T + f" SELECT leg_x, leg_y, date, CASE WHEN count(spread) {_rows(20)} >= 10 AND count(spread) {_rows(60)} >= 30 AND stddev_samp(spread) {_rows(20)} > 1.5 * stddev_samp(spread) {_rows(60)} THEN 1 ELSE 0 END AS regime FROM sp", dates="date")
def _(spark, d):
    return w.regime_flags(_spread(spark, d)).select(*P, "date", "regime")


@query("w6_rolling_correlation", i.TYPES + f" SELECT leg_x, leg_y, date, round(CASE WHEN count(*) {_rows(126)} >= 126 THEN corr(x, y) {_rows(126)} END, 6) AS corr FROM al", dates="date")
def _(spark, d):
    return w.rolling_correlation(i.few(spark, d), 126).select(*P, "date", r6("corr"))


@query("w11_rolling_ols", i.TYPES + f" SELECT leg_x, leg_y, date, round(CASE WHEN count(*) {_rows(60)} >= 60 THEN regr_slope(x, y) {_rows(60)} END, 6) AS hedge FROM al", dates="date")
def _(spark, d):
    return w.rolling_ols(i.few(spark, d), 60).select(*P, "date", r6("hedge"))


@query("x9_trailing_hedge", i.TYPES + ", tl AS (SELECT *, row_number() OVER (PARTITION BY leg_x, leg_y ORDER BY date DESC) AS k FROM al) SELECT leg_x, leg_y, max(date) AS date, round(regr_slope(ln(x), ln(y)), 6) AS hedge, round(regr_intercept(ln(x), ln(y)), 6) AS intercept, count(*) AS n_obs FROM tl WHERE k <= 63 GROUP BY ALL", dates="date")
def _(spark, d):
    return e.trailing_hedge(i.few(spark, d)).select(*P, "date", r6("hedge"), r6("intercept"), "n_obs")


@query("w13_rolling_ou", L + f" SELECT leg_x, leg_y, date, round(CASE WHEN count(lg) {_rows(251)} >= 251 THEN regr_slope(s, lg) {_rows(251)} END, 6) AS beta FROM lg", dates="date")
def _(spark, d):
    return w.rolling_ols(e.lagged(_spread(spark, d)).where("lag IS NOT NULL").withColumnRenamed("s", "x").withColumnRenamed("lag", "y"), 251).select(*P, "date", r6("hedge", "beta")).unionByName(e.lagged(_spread(spark, d)).where("lag IS NULL").select(*P, "date", F.lit(None).cast("double").alias("beta")))


@query("w8_zero_crossings", T + ", tl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY leg_x, leg_y ORDER BY date DESC) AS n FROM sp) WHERE n <= 252), sg AS (SELECT *, CASE WHEN spread - avg(spread) OVER (PARTITION BY leg_x, leg_y) < 0 THEN -1 ELSE 1 END AS g FROM tl), cr AS (SELECT *, CASE WHEN g <> lag(g) OVER (PARTITION BY leg_x, leg_y ORDER BY date) THEN 1 ELSE 0 END AS c FROM sg) SELECT leg_x, leg_y, count(*) AS n, CAST(sum(c) AS BIGINT) AS crossings, round(sum(c) * 252.0 / count(*), 6) AS rate, round(count(*) / (2.0 * sum(c)), 6) AS holding FROM cr GROUP BY ALL")
def _(spark, d):
    return w.zero_crossings(_spread(spark, d)).select(*P, "n", "crossings", r6("rate"), r6("holding"))


MONTHLY = ", rb AS (SELECT leg_x, leg_y, last_day(m) AS d FROM (SELECT leg_x, leg_y, unnest(ms) AS m FROM (SELECT leg_x, leg_y, generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH) AS ms FROM al GROUP BY leg_x, leg_y))), mo AS (SELECT rb.leg_x, rb.leg_y, CAST(rb.d AS DATE) AS date, regr_slope(ln(x), ln(y)) AS hedge, regr_intercept(ln(x), ln(y)) AS intercept, regr_r2(ln(x), ln(y)) AS r2, count(*) AS n_obs FROM rb JOIN al ON al.leg_x = rb.leg_x AND al.leg_y = rb.leg_y AND al.date <= rb.d AND al.date > rb.d - INTERVAL 6 MONTH GROUP BY ALL HAVING count(*) >= 60)"


@query("w12_monthly_ols", i.TYPES + MONTHLY + " SELECT leg_x, leg_y, date, round(hedge, 6) AS hedge, round(intercept, 6) AS intercept, round(r2, 6) AS r2, n_obs FROM mo", dates="date")
def _(spark, d):
    return panes.month_ends(i.few(spark, d), 6, 60).select(*P, "date", r6("hedge"), r6("intercept"), r6("r2"), "n_obs")


@query("j4_asof_hedge", i.TYPES + MONTHLY + " SELECT al.leg_x, al.leg_y, al.date, round(mo.hedge, 6) AS hedge FROM al ASOF LEFT JOIN mo ON al.leg_x = mo.leg_x AND al.leg_y = mo.leg_y AND al.date >= mo.date", dates="date")
def _(spark, d):
    a = i.few(spark, d)
    return e.asof(a, panes.month_ends(a, 6, 60), "hedge").select(*P, "date", r6("hedge"))


@query("a13_hedge_stability", i.TYPES + MONTHLY + ", nm AS (SELECT *, row_number() OVER (PARTITION BY leg_x, leg_y ORDER BY date) AS k, count(*) OVER (PARTITION BY leg_x, leg_y) AS n FROM mo), q AS (SELECT leg_x, leg_y, count(*) AS n, avg(hedge) AS mean, stddev_samp(hedge) AS sd, avg(hedge) FILTER (k <= n // 2) AS a, avg(hedge) FILTER (k > n // 2) AS b FROM nm GROUP BY ALL) SELECT leg_x, leg_y, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd / abs(mean), 4) AS cv, round(abs(b - a) / abs(a), 4) AS drift FROM q")
def _(spark, d):
    m = panes.month_ends(i.few(spark, d), 6, 60)
    x = w.W.partitionBy(*P)
    k = m.withColumn("k", F.row_number().over(x.orderBy("date"))).withColumn("n", F.count(F.lit(1)).over(x))
    first = F.col("k") <= F.floor(F.col("n") / 2)
    q = k.groupBy(*P).agg(F.count(F.lit(1)).alias("n"), F.avg("hedge").alias("mean"), F.stddev_samp("hedge").alias("sd"), F.avg(F.when(first, F.col("hedge"))).alias("a"), F.avg(F.when(~first, F.col("hedge"))).alias("b"))
    return q.select(*P, "n", r6("mean"), r6("sd"), F.round(F.col("sd") / F.abs("mean"), 4).alias("cv"), F.round(F.abs(F.col("b") - F.col("a")) / F.abs("a"), 4).alias("drift"))


ROLL = ", nb AS (SELECT *, row_number() OVER (PARTITION BY leg_x, leg_y ORDER BY date) AS rn, count(*) OVER (PARTITION BY leg_x, leg_y) AS nn FROM al), wn AS (SELECT nb.*, k AS win FROM nb JOIN range(200) g(k) ON rn > k * 21 AND rn <= k * 21 + 252 AND k * 21 + 252 <= nn)"


@query("w10_rolling_windows", i.TYPES + ROLL + " SELECT leg_x, leg_y, win AS \"window\", count(*) AS n, max(date) AS date, round(regr_slope(ln(x), ln(y)), 6) AS hedge FROM wn GROUP BY ALL", dates="date")
def _(spark, d):
    return panes.rolling(i.few(spark, d), 252, 21).select(*P, "window", F.col("n_obs").alias("n"), "date", r6("hedge"))


@query("w10_rolling_cointegration", i.TYPES + ROLL.replace("FROM al)", "FROM al)").replace("wn AS", "w0 AS") + ", wn AS (SELECT leg_x || '_' || leg_y || '_' || win AS leg_x, '' AS leg_y, date, x, y FROM w0), hg AS (SELECT leg_x, leg_y, regr_slope(ln(x), ln(y)) AS hedge, regr_intercept(ln(x), ln(y)) AS intercept FROM wn GROUP BY ALL)" + EG.replace("FROM al JOIN hg", "FROM wn JOIN hg").replace("al.leg_x, al.leg_y", "wn.leg_x, wn.leg_y") + " SELECT leg_x AS name, lag_used, round(t_stat, 5) AS t_stat FROM eg")
def _(spark, d):
    return panes.rolling(i.few(spark, d), 252, 21).select(F.concat_ws("_", *P, "window").alias("name"), "lag_used", F.round("t_stat", 5).alias("t_stat"))


@query("w15_walk_forward", i.TYPES + ", wd AS (SELECT CAST(k AS INT) AS window_id, DATE '1995-01-02' + to_months(CAST(k * 6 AS INT)) AS t0, DATE '1995-01-02' + to_months(CAST(k * 6 + 12 AS INT)) AS t1, DATE '1995-01-02' + to_months(CAST(k * 6 + 18 AS INT)) AS t2 FROM range(100) g(k)) SELECT window_id, CASE WHEN date < t1 THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM px JOIN wd ON date >= t0 AND date < t2 WHERE t2 <= DATE '2001-11-04' GROUP BY ALL")
def _(spark, d):
    return w.walk_forward(i.types(spark, d), "1995-01-02", "2001-11-04").groupBy("window_id", "part").agg(F.count(F.lit(1)).alias("n"))


@query("w16_ratio_split", i.TYPES + ", dd AS (SELECT date, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM px)) SELECT CASE WHEN k <= floor(n * 0.7) THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM px JOIN dd USING (date) GROUP BY part")
def _(spark, d):
    return w.ratio_split(i.types(spark, d)).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("w18_percentile", i.WEEK + " SELECT a.ticker, a.date, round(avg((b.px < a.px)::INT), 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM px) a JOIN (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM px) b ON a.ticker = b.ticker AND b.n BETWEEN a.n - 51 AND a.n GROUP BY ALL", dates="date")
def _(spark, d):
    return w.percentile_below(i.brand(spark, d), "px", 52, ("ticker",), "date").select("ticker", "date", r6("share"))


@query("w19_normalised_range", i.TYPES + ", tl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY leg_x, leg_y ORDER BY date DESC) AS n FROM al) WHERE n <= 252), g AS (SELECT leg_x, leg_y, 100 * x / first_value(x) OVER (PARTITION BY leg_x, leg_y ORDER BY date) - 100 * y / first_value(y) OVER (PARTITION BY leg_x, leg_y ORDER BY date) AS gap FROM tl) SELECT leg_x, leg_y, count(*) AS n, round(max(gap) - min(gap), 6) AS range_pct FROM g GROUP BY ALL")
def _(spark, d):
    return w.normalised_range(i.few(spark, d)).select(*P, "n", r6("range_pct"))
