"""Queries: pair scans, stability, holding times, volatility look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import estimators, lookups, pairs, panels, validation
from . import inputs as i
from . import pair_scan
from .q_series import EG, PV, T
from .registry import query, r6

P = pairs.PAIR


def _spread(spark, d):
    a = i.few(spark, d)
    return estimators.spread(a, estimators.hedge(a))


def _windowed(rows: str) -> str:
    """hg, eg and wh (half_life) of each (leg_x, leg_y) of rows, SQL of leg_x, leg_y, date, x, y."""
    eg = EG.replace("FROM al JOIN hg", "FROM wn JOIN hg").replace("al.leg_x, al.leg_y", "wn.leg_x, wn.leg_y")
    return f""", wn AS ({rows}), hg AS (SELECT leg_x, leg_y, regr_slope(ln(x), ln(y)) AS hedge, regr_intercept(ln(x), ln(y)) AS intercept, regr_r2(ln(x), ln(y)) AS r2, count(*) AS n_obs FROM wn GROUP BY ALL){eg},
ws AS (SELECT *, lag(s) OVER (PARTITION BY leg_x, leg_y ORDER BY date) AS lg FROM (SELECT wn.leg_x, wn.leg_y, date, ln(x) - hedge * ln(y) AS s FROM wn JOIN hg USING (leg_x, leg_y))),
wh AS (SELECT leg_x, leg_y, CASE WHEN b < 0 AND b > -1 THEN -ln(2) / ln(1 + b) END AS half_life FROM (SELECT leg_x, leg_y, regr_slope(s - lg, lg) AS b FROM ws GROUP BY ALL))"""


NUMBERED = ", nb AS (SELECT *, row_number() OVER (PARTITION BY leg_x, leg_y ORDER BY date) - 1 AS k, count(*) OVER (PARTITION BY leg_x, leg_y) AS n FROM al)"
T10 = scalars.coint_threshold(0.10)
SUMMARY = f"""SELECT leg_x AS pair, count(*) AS n_windows, round(avg(t_stat), 5) AS mean_t, round(stddev_samp(t_stat), 5) AS std_t, round(avg((t_stat < {T10!r})::INT), 6) AS pct_significant,
round(avg(half_life), 6) AS mean_half_life, round(stddev_samp(half_life), 6) AS std_half_life, round(stddev_samp(hedge) / abs(avg(hedge)), 5) AS hedge_cv, round((list(t_stat ORDER BY leg_y DESC))[1], 5) AS latest_t,
round((list(hedge ORDER BY leg_y DESC))[1], 5) AS latest_hedge, round((list(half_life ORDER BY leg_y DESC))[1], 6) AS latest_half_life FROM eg JOIN hg USING (leg_x, leg_y) JOIN wh USING (leg_x, leg_y) GROUP BY leg_x HAVING count(*) >= 3"""
ROLLED = i.TYPES + NUMBERED + _windowed("SELECT leg_x || '|' || leg_y AS leg_x, g.w AS leg_y, date, x, y FROM nb JOIN range(200) g(w) ON k >= g.w * 21 AND k < g.w * 21 + 252 AND g.w * 21 + 252 <= n")


def _summary(rows):
    digits = {"mean_t": 5, "std_t": 5, "pct_significant": 6, "mean_half_life": 6, "std_half_life": 6, "hedge_cv": 5, "latest_t": 5, "latest_hedge": 5, "latest_half_life": 6}
    return rows.select(F.concat_ws("|", *P).alias("pair"), "n_windows", *[F.round(c, k).alias(c) for c, k in digits.items()])


@query("v2_rolling_pair_scan", f"{ROLLED} {SUMMARY}")
def _(spark, d):
    return _summary(pair_scan.rolling_scan(i.types(spark, d), min_corr=-1.0))


@query("v5_tradeable_pairs", f"{ROLLED} SELECT * FROM ({SUMMARY}) WHERE pct_significant >= 0.7 AND latest_t < {T10!r} AND latest_half_life BETWEEN 0 AND 120")
def _(spark, d):
    return _summary(pair_scan.tradeable(pair_scan.rolling_scan(i.types(spark, d), min_corr=-1.0), low=0.0))


WHOLE = "al AS (SELECT a.ticker AS leg_x, b.ticker AS leg_y, a.date, a.px AS x, b.px AS y FROM pa a JOIN pa b ON a.date = b.date AND a.ticker < b.ticker)"
V1 = f"""WITH pa AS ({i.panel_sql('week')}), px AS (SELECT * FROM pa WHERE date IN (SELECT DISTINCT date FROM pa ORDER BY date DESC LIMIT 300)),
u AS (SELECT DISTINCT ticker FROM px), {WHOLE.replace('pa a', 'px a').replace('pa b', 'px b')}, {i.SECTORS}""" + _windowed("SELECT * FROM al") + PV + f""",
rt AS (SELECT ticker, date, px / lag(px) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM px),
fd AS (SELECT date FROM rt GROUP BY date HAVING count(r) = (SELECT count(*) FROM u)),
co AS (SELECT a.ticker AS leg_x, b.ticker AS leg_y, corr(a.r, b.r) AS corr FROM rt a JOIN rt b ON a.date = b.date AND a.ticker < b.ticker JOIN fd ON fd.date = a.date GROUP BY ALL),
sm AS (SELECT leg_x, leg_y, avg(s) AS spread_mean, stddev_samp(s) AS spread_std FROM ws GROUP BY ALL),
tl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY leg_x, leg_y ORDER BY date DESC) AS k FROM al) WHERE k <= 252),
ga AS (SELECT leg_x, leg_y, 100 * x / first_value(x) OVER w - 100 * y / first_value(y) OVER w AS gap FROM tl WINDOW w AS (PARTITION BY leg_x, leg_y ORDER BY date)),
rg AS (SELECT leg_x, leg_y, CASE WHEN count(*) >= 126 THEN max(gap) - min(gap) END AS spread_range_pct FROM ga GROUP BY ALL),
rw AS (WITH {WHOLE}{NUMBERED}{_windowed("SELECT leg_x || '|' || leg_y AS leg_x, g.w AS leg_y, date, x, y FROM nb JOIN range(200) g(w) ON k >= g.w * 13 AND k < g.w * 13 + 104 AND g.w * 13 + 104 <= n")}
  SELECT leg_x AS pair, count(*) FILTER (t_stat < {T10!r} AND half_life > 0 AND half_life < 120) / count(t_stat) AS share FROM eg JOIN wh USING (leg_x, leg_y) GROUP BY leg_x),
o AS (SELECT *, CASE WHEN pvalue > 0.1 THEN 'pvalue' WHEN half_life IS NULL THEN 'half_life' WHEN half_life < 0.1 THEN 'half_life_low' WHEN half_life > 120 THEN 'half_life_high' WHEN spread_range_pct < 0 THEN 'spread_range_low' END AS early
  FROM co JOIN hg USING (leg_x, leg_y) JOIN pv USING (leg_x, leg_y) JOIN wh USING (leg_x, leg_y) JOIN sm USING (leg_x, leg_y) JOIN rg USING (leg_x, leg_y)
  WHERE corr BETWEEN -1 AND 0.99 AND n_obs >= 100 AND (SELECT sector FROM sec WHERE ticker = leg_x) = (SELECT sector FROM sec WHERE ticker = leg_y))
SELECT leg_x, leg_y, round(corr, 6) AS correlation, n_obs, round(spread_mean, 6) AS spread_mean, round(spread_std, 6) AS spread_std, round(hedge, 6) AS hedge_ratio, round(t_stat, 5) AS coint_statistic, round(pvalue, 9) AS coint_pvalue,
round(half_life, 6) AS half_life, round(spread_range_pct, 6) AS spread_range_pct, CASE WHEN early IS NOT NULL THEN early WHEN share IS NULL THEN 'rolling_no_windows' WHEN share < 0.3 THEN 'rolling_consistency:' || CAST(round_even(share * 100, 0) AS BIGINT) || '%<30%' END AS excluded_reason
FROM o LEFT JOIN rw ON rw.pair = leg_x || '|' || leg_y"""


@query("v1_pair_scan", V1)
def _(spark, d):
    how = pair_scan.Scan(min_obs=100, min_corr=-1.0, min_half_life=0.1, lookback=300, max_pairs="all", rolling_share=0.3, rolling_rows=104, rolling_step=13)
    out = pair_scan.scan(i.brand(spark, d), how, metadata=i.sectors(spark, d).withColumn("tracks_index", F.lit(None).cast("string")))
    # The figure in a reason is one of the columns, but for the share of windows.
    kind = F.when(F.col("excluded_reason").startswith("rolling"), F.col("excluded_reason")).otherwise(F.substring_index("excluded_reason", ":", 1))
    digits = {"spread_mean": 6, "spread_std": 6, "hedge_ratio": 6, "coint_statistic": 5, "coint_pvalue": 9, "half_life": 6, "spread_range_pct": 6}
    return out.select(*P, F.round("correlation", 6).alias("correlation"), "n_obs", *[F.round(c, k).alias(c) for c, k in digits.items()], kind.alias("excluded_reason"))


PARTS = _windowed("SELECT leg_x || '|' || leg_y AS leg_x, CASE WHEN k < floor(n * 0.75) THEN 'train' ELSE 'val' END AS leg_y, date, x, y FROM nb")


@query(
    "x11_pair_stability",
    i.TYPES + NUMBERED + PARTS + """, es AS (SELECT leg_x, leg_y AS part, hedge, t_stat, half_life FROM hg JOIN eg USING (leg_x, leg_y) JOIN wh USING (leg_x, leg_y)),
    bo AS (SELECT a.leg_x AS pair, a.hedge AS h0, b.hedge AS h1, a.t_stat AS t0, b.t_stat AS t1, a.half_life AS l0, b.half_life AS l1, b.half_life / a.half_life AS lr, b.hedge / a.hedge AS hr FROM es a JOIN es b ON a.leg_x = b.leg_x AND a.part = 'train' AND b.part = 'val'),
    rn AS (SELECT *, CASE WHEN NOT coalesce(t0 <= -3.04 AND l0 BETWEEN 0.05 AND 30, false) THEN 'train' WHEN NOT coalesce(t1 <= -2.86 AND l1 BETWEEN 0.025 AND 60, false) THEN 'validation' WHEN NOT coalesce(lr BETWEEN 0.5 AND 2, false) THEN 'half_life_ratio' WHEN NOT coalesce(hr BETWEEN 0.6 AND 1.67, false) THEN 'hedge_ratio' END AS reason FROM bo)
    SELECT pair, round(h0, 6) AS hedge_train, round(h1, 6) AS hedge_val, round(l0, 6) AS half_life_train, round(l1, 6) AS half_life_val, round(lr, 5) AS hl_ratio, round(hr, 4) AS hedge_ratio, reason, round(CASE WHEN reason IS NULL THEN greatest(1 - (abs(lr - 1) + abs(hr - 1)) / 2, 0) ELSE 0 END, 5) AS score FROM rn""",
)
def _(spark, d):
    s = validation.stability(i.few(spark, d), -3.04, -2.86, 0.05, 30.0)
    return s.select(F.concat_ws("|", *P).alias("pair"), *[r6(c) for c in ("hedge_train", "hedge_val", "half_life_train", "half_life_val")], F.round("hl_ratio", 5).alias("hl_ratio"), F.round("hedge_ratio", 4).alias("hedge_ratio"), "reason", F.round("score", 5).alias("score"))


SHARES = _windowed("SELECT leg_x || '|' || leg_y AS leg_x, g.w AS leg_y, date, x, y FROM (SELECT *, CAST(floor(n * 0.6) AS BIGINT) AS sz FROM nb) JOIN range(4) g(w) ON k >= g.w * ((n - sz) // 3) AND k < g.w * ((n - sz) // 3) + sz")


@query(
    "x12_rolling_consistency",
    i.TYPES + NUMBERED + SHARES + """, es AS (SELECT leg_x, hedge, half_life, coalesce(t_stat <= -3.0 AND half_life BETWEEN 0.1 AND 100, false) AS ok FROM hg JOIN eg USING (leg_x, leg_y) JOIN wh USING (leg_x, leg_y)),
    q AS (SELECT leg_x AS pair, count(*) AS n_windows, count(*) FILTER (ok) AS n_passed, stddev_pop(half_life) FILTER (ok) / abs(avg(half_life) FILTER (ok)) AS a, stddev_pop(hedge) FILTER (ok) / abs(avg(hedge) FILTER (ok)) AS b FROM es GROUP BY leg_x)
    SELECT pair, n_windows, n_passed, round(CASE WHEN n_passed >= 2 THEN greatest(1 - (a + b) / 2, 0) WHEN n_passed > 0 THEN 0.5 ELSE 0 END, 5) AS score FROM q""",
)
def _(spark, d):
    return validation.consistency(i.few(spark, d), -3.0, 0.1, 100.0).select(F.concat_ws("|", *P).alias("pair"), "n_windows", "n_passed", F.round("score", 5).alias("score"))


GATED = ["hedge", "intercept", "r2", "half_life", "spread_std", "spread_range", "snr", "crossing_rate", "expected_holding"]


@query(
    "x2_cointegration_gates",
    i.WEEK + _windowed("SELECT * FROM al") + PV + """, s2 AS (SELECT leg_x, leg_y, date, s - intercept AS s, lg - intercept AS lg FROM ws JOIN hg USING (leg_x, leg_y)),
    sm AS (SELECT leg_x, leg_y, avg(s) AS spread_mean, stddev_samp(s) AS spread_std, max(s) - min(s) AS spread_range, stddev_samp(s) / stddev_samp(s - lg) AS snr FROM s2 GROUP BY ALL),
    tl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY leg_x, leg_y ORDER BY date DESC) AS k FROM s2) WHERE k <= 252),
    sg AS (SELECT *, CASE WHEN s - avg(s) OVER (PARTITION BY leg_x, leg_y) < 0 THEN -1 ELSE 1 END AS g FROM tl),
    cr AS (SELECT *, (g <> lag(g) OVER (PARTITION BY leg_x, leg_y ORDER BY date))::INT AS c FROM sg),
    zc AS (SELECT leg_x, leg_y, sum(c) * 252.0 / count(*) AS crossing_rate, count(*) / (2.0 * sum(c)) AS expected_holding FROM cr GROUP BY ALL),
    o AS (SELECT * FROM hg JOIN pv USING (leg_x, leg_y) JOIN wh USING (leg_x, leg_y) JOIN sm USING (leg_x, leg_y) JOIN zc USING (leg_x, leg_y))
    SELECT leg_x, leg_y, """ + ", ".join(f"round({c}, 6) AS {c}" for c in GATED) + """, round(t_stat, 5) AS t_stat, round(pvalue, 9) AS pvalue, n_obs,
    CASE WHEN n_obs < 60 THEN 'rows' WHEN NOT coalesce(pvalue <= 0.05, false) THEN 'pvalue' WHEN NOT coalesce(half_life BETWEEN 0.2 AND 30, false) THEN 'half_life' END AS reason FROM o""",
)
def _(spark, d):
    g = validation.cointegrated(i.aligned(spark, d), low=0.2)
    return g.select(*P, *[r6(c) for c in GATED], F.round("t_stat", 5).alias("t_stat"), F.round("pvalue", 9).alias("pvalue"), "n_obs", "reason")


@query("x16_holding_percentiles", T + ", sg AS (SELECT *, CASE WHEN spread - avg(spread) OVER (PARTITION BY leg_x, leg_y) < 0 THEN -1 ELSE 1 END AS g, row_number() OVER (PARTITION BY leg_x, leg_y ORDER BY date) AS k FROM sp), cr AS (SELECT *, g <> lag(g) OVER (PARTITION BY leg_x, leg_y ORDER BY date) AS c FROM sg), ht AS (SELECT leg_x, leg_y, k - lag(k) OVER (PARTITION BY leg_x, leg_y ORDER BY date) AS h FROM cr WHERE c) SELECT leg_x, leg_y, count(h) AS n, round(avg(h), 6) AS mean, quantile_cont(h, 0.25) AS p25, quantile_cont(h, 0.75) AS p75 FROM ht GROUP BY ALL")
def _(spark, d):
    h = validation.holding_percentiles(_spread(spark, d))
    return h.select(*P, "n", r6("mean"), F.col("percentiles")[1].alias("p25"), F.col("percentiles")[3].alias("p75"))


@query("x15_bootstrap_holding")
def _(spark, d):
    return validation.bootstrap_holding(_spread(spark, d))


@query("j6_volatility_lookup", i.TYPES + ", v AS (SELECT date, px % 40 AS vix FROM px WHERE ticker = 'PROMO' AND day(date) % 4 <> 0), m AS (SELECT date, vix, avg(vix) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean FROM v), dd AS (SELECT DISTINCT date FROM px) SELECT dd.date, round(vix, 4) AS vix, round(mean, 4) AS mean, coalesce(vix > 30 OR mean > 30, false) AS high FROM dd ASOF LEFT JOIN m ON dd.date >= m.date", dates="date")
def _(spark, d):
    p = i.types(spark, d)
    vix = p.where((F.col("ticker") == "PROMO") & (F.day("date") % 4 != 0)).select("date", (F.col("px") % 40).alias("vix"))
    return validation.vix_filter(panels.calendar(p), vix).select("date", F.round("vix", 4).alias("vix"), F.round("mean", 4).alias("mean"), "high")


@query("u5_baskets", i.WEEK + ", c AS (SELECT leg_x AS a, leg_y AS b, corr(x, y) AS c FROM al GROUP BY ALL) SELECT p.a || ',' || p.b || ',' || q.b AS members, round((p.c + q.c + r.c) / 3, 6) AS mean_corr FROM c p JOIN c q ON q.a = p.b JOIN c r ON r.a = p.a AND r.b = q.b WHERE p.c + q.c + r.c >= 3 * 0.05")
def _(spark, d):
    a = i.aligned(spark, d)
    return validation.baskets(pairs.correlation(a), panels.positions(i.brand(spark, d)), 3, 0.05).select("members", r6("mean_corr"))


@query("x13_adaptive_holding", "SELECT o_orderkey AS k, CAST(greatest(least(floor(2.5 * CASE WHEN o_totalprice % 120 BETWEEN 3 AND 100 THEN 0.5 * (o_totalprice % 120) + 0.5 * (o_orderkey % 30) ELSE o_orderkey % 30 END), 45), 5) AS INT) AS days FROM orders")
def _(spark, d):
    return i.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), validation.adaptive_max_holding(F.col("o_totalprice") % 120, (F.col("o_orderkey") % 30).cast("double")).alias("days"))


@query("j10_nearest_date", i.TYPES + ", q AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS q FROM orders), c AS (SELECT DISTINCT date FROM px), n AS (SELECT q.q, a.date AS a, b.date AS b FROM q ASOF LEFT JOIN c a ON q.q >= a.date ASOF LEFT JOIN c b ON q.q <= b.date) SELECT q, CASE WHEN b IS NULL OR q - a <= b - q THEN a ELSE b END AS date FROM n", dates="q date")
def _(spark, d):
    return lookups.nearest(i.read(spark, d, "orders").select(F.to_date("o_orderdate").alias("q")), panels.calendar(i.types(spark, d)))


@query("f12_trend", i.WEEK + " SELECT ticker, date, round(px / lag(px, 60) OVER (PARTITION BY ticker ORDER BY date) - 1, 6) AS trend FROM px", dates="date")
def _(spark, d):
    return validation.trend(i.brand(spark, d)).select("ticker", "date", r6("trend"))
