"""Queries: scans, panels, pairs and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import comoments, pairs, panels, windows
from . import inputs as i
from .registry import query, r6

W, D = i.WEEK, i.DAY
FULL = ", g AS (SELECT t.ticker, d.date, px.px FROM (SELECT DISTINCT ticker FROM px) t CROSS JOIN (SELECT DISTINCT date FROM px) d LEFT JOIN px ON px.ticker = t.ticker AND px.date = d.date)"
FILLED = ", f AS (SELECT ticker, date, coalesce(last_value(px IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(px IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS px FROM g)"


@query("s1_long_panel", D + " SELECT date, ticker, round(px, 6) AS px FROM px", dates="date")
def _(spark, d):
    return i.brand(spark, d, "day").select("date", "ticker", r6("px"))


@query("s2_first_row_of_a_date", "SELECT ticker, date, px FROM (SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, o_totalprice AS px, row_number() OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1", dates="date")
def _(spark, d):
    return panels.sanitise(i.read(spark, d, "orders").select(F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("px"), "o_orderkey"), "o_orderkey")


KINDS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("s8_wide_panel", i.TYPES + " SELECT date, " + ", ".join(f'round(max(px) FILTER (ticker = \'{k}\'), 6) AS "{k}"' for k in KINDS) + " FROM px GROUP BY date", dates="date")
def _(spark, d):
    return panels.pivot(i.types(spark, d), KINDS).select("date", *[r6(k) for k in KINDS])


@query("p1_select_tickers", W + " SELECT date, ticker, round(px, 6) AS px, pos FROM (SELECT date, upper(ticker) AS ticker, px FROM px) JOIN (VALUES ('BRAND#12', 0), ('BRAND#3', 1)) v(t, pos) ON ticker = t", dates="date")
def _(spark, d):
    return panels.select_tickers(i.brand(spark, d).withColumn("ticker", F.upper("ticker")), [" brand#12", "Brand#3", "BRAND#12", "none"], True).select("date", "ticker", r6("px"), "pos")


@query("p2_drop_sparse", D + " SELECT ticker, count(*) AS n FROM px GROUP BY ticker HAVING count(px) >= (SELECT CAST(0.9 * max(c) AS INT) FROM (SELECT count(*) AS c FROM px GROUP BY ticker))")
def _(spark, d):
    p = i.brand(spark, d, "day")
    most = p.groupBy("ticker").count().agg(F.round(F.max("count") * 0.9).cast("int")).first()[0]
    return panels.drop_sparse(p, most).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query("p3_fill_formation_gaps", D + FULL + FILLED + ", k AS (SELECT ticker FROM g GROUP BY ticker HAVING avg((px IS NULL)::INT) <= 0.45) SELECT ticker, date, round(px, 6) AS px FROM f WHERE ticker IN (SELECT ticker FROM k)", dates="date")
def _(spark, d):
    return panels.fill_gaps(i.brand(spark, d, "day"), 0.45).select("ticker", "date", r6("px"))


@query("p4_quality_filter", D + " SELECT ticker, count(px) AS n_prices, round(1 - count(px) / (SELECT count(DISTINCT date) FROM px), 6) AS missing, count(px) >= 300 AND 1 - count(px) / (SELECT count(DISTINCT date) FROM px) <= 0.4 AS passes FROM px GROUP BY ticker")
def _(spark, d):
    return panels.quality(i.brand(spark, d, "day"), 300, 0.4).select("ticker", "n_prices", r6("missing"), "passes")


@query("w7_fill", D + FULL + FILLED + " SELECT ticker, date, round(px, 6) AS px FROM f", dates="date")
def _(spark, d):
    return panels.fill(panels.complete(i.brand(spark, d, "day"))).select("ticker", "date", r6("px"))


@query("p18_years", W + " SELECT date, ticker, round(px, 6) AS px FROM px WHERE year(date) BETWEEN 1996 AND 1998", dates="date")
def _(spark, d):
    return panels.years(i.brand(spark, d), 1996, 1998).select("date", "ticker", r6("px"))


@query("p19_last_dates", W + " SELECT date, ticker, round(px, 6) AS px FROM px WHERE date IN (SELECT DISTINCT date FROM px ORDER BY date DESC LIMIT 52)", dates="date")
def _(spark, d):
    return panels.last_dates(i.brand(spark, d), 52).select("date", "ticker", r6("px"))


RET = ", rt AS (SELECT ticker, date, ln(px) - lag(ln(px)) OVER (PARTITION BY ticker ORDER BY date) AS r FROM px)"


@query("f1_log_returns", W + RET + " SELECT ticker, date, round(r, 6) AS r FROM rt", dates="date")
def _(spark, d):
    return panels.returns(i.brand(spark, d)).select("ticker", "date", r6("r"))


@query("f1_simple_returns", D + FULL + ", h AS (SELECT ticker, date, last_value(px IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px FROM g) SELECT ticker, date, round(px / lag(px) OVER (PARTITION BY ticker ORDER BY date) - 1, 6) AS r FROM h", dates="date")
def _(spark, d):
    return panels.returns(panels.complete(i.brand(spark, d, "day")), "simple").select("ticker", "date", r6("r"))


@query("a4_validation_summary", D + FULL + ", h AS (SELECT ticker, date, px, last_value(px IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM g), q AS (SELECT *, p / lag(p) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM h) SELECT ticker, count(*) AS n_days, round(avg((px IS NULL)::INT), 4) AS missing, count(*) FILTER (abs(r) > 0.15) AS n_jumps, count(px) = 0 AS empty FROM q GROUP BY ticker")
def _(spark, d):
    return panels.validation_summary(i.brand(spark, d, "day")).withColumn("n_jumps", F.col("n_jumps").cast("long"))


@query("j5_currency_conversion", i.TYPES + ", c AS (SELECT ticker, CASE WHEN pos < 2 THEN 'AAA' WHEN pos < 4 THEN 'BBB' ELSE 'CCC' END AS currency FROM u), rt AS (SELECT DISTINCT date, cur AS currency, round(1 + (day(date) % 5) / 10.0 + k, 4) AS rate FROM px, (VALUES ('AAA', 0), ('BBB', 1)) v(cur, k) WHERE day(date) % 3 <> 0), g AS (SELECT v.cur AS currency, dd.date, rt.rate AS px FROM (VALUES ('AAA'), ('BBB')) v(cur) CROSS JOIN (SELECT DISTINCT date FROM px) dd LEFT JOIN rt ON rt.currency = v.cur AND rt.date = dd.date), f AS (SELECT currency, date, coalesce(last_value(px IGNORE NULLS) OVER (PARTITION BY currency ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(px IGNORE NULLS) OVER (PARTITION BY currency ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS rate FROM g) SELECT px.date, px.ticker, c.currency, round(px.px * coalesce(f.rate, 1.0), 6) AS px FROM px JOIN c USING (ticker) LEFT JOIN f ON f.currency = c.currency AND f.date = px.date", dates="date")
def _(spark, d):
    p = i.types(spark, d)
    currency = panels.positions(p).select("ticker", F.when(F.col("pos") < 2, "AAA").when(F.col("pos") < 4, "BBB").otherwise("CCC").alias("currency"))
    k = F.explode(F.array(F.struct(F.lit("AAA").alias("currency"), F.lit(0).alias("k")), F.struct(F.lit("BBB").alias("currency"), F.lit(1).alias("k"))))
    rates = panels.calendar(p).where(F.day("date") % 3 != 0).select("date", k.alias("c")).select("date", "c.currency", F.round(1 + F.day("date") % 5 / 10.0 + F.col("c.k"), 4).alias("rate"))
    return panels.convert(p, currency, rates).select("date", "ticker", "currency", r6("px"))


@query("j1_align", W + " SELECT leg_x, leg_y, count(*) AS n, round(sum(x), 4) AS sx, round(sum(y), 4) AS sy FROM al GROUP BY ALL HAVING count(*) >= 30")
def _(spark, d):
    return i.aligned(spark, d).groupBy(*pairs.PAIR).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("sx"), F.round(F.sum("y"), 4).alias("sy")).where("n >= 30")


@query("j2_enumerate_pairs", W + " SELECT a.ticker AS leg_x, a.pos AS pos_x, b.ticker AS leg_y, b.pos AS pos_y FROM u a JOIN u b ON a.pos < b.pos")
def _(spark, d):
    return pairs.enumerate_pairs(panels.positions(i.brand(spark, d)))


def _returns(spark, d):
    return i.placed(panels.returns(i.brand(spark, d)))


CORR = RET + ", cr AS (SELECT a.ticker AS leg_x, b.ticker AS leg_y, corr(a.r, b.r) AS corr, count(*) AS n_obs FROM rt a JOIN rt b ON a.date = b.date AND a.r IS NOT NULL AND b.r IS NOT NULL JOIN u ua ON a.ticker = ua.ticker JOIN u ub ON b.ticker = ub.ticker WHERE ua.pos < ub.pos GROUP BY ALL)"


@query("a1_correlation_matrix", W + CORR + " SELECT leg_x, leg_y, round(corr, 6) AS corr, n_obs FROM cr")
def corr_matrix(spark, d):
    return comoments.correlation(_returns(spark, d), "r").select("leg_x", "leg_y", r6("corr"), "n_obs")


@query("a2_listwise_correlation", W + RET + ", ok AS (SELECT date FROM rt GROUP BY date HAVING count(r) = (SELECT count(*) FROM u)) SELECT a.ticker AS leg_x, b.ticker AS leg_y, round(corr(a.r, b.r), 6) AS corr, count(*) AS n_obs FROM rt a JOIN rt b ON a.date = b.date JOIN ok ON ok.date = a.date WHERE a.ticker < b.ticker GROUP BY ALL")
def _(spark, d):
    return comoments.correlation(pairs.listwise(_returns(spark, d)), "r").select("leg_x", "leg_y", r6("corr"), "n_obs")


def _corr(spark, d):
    return comoments.correlation(_returns(spark, d), "r").select("leg_x", "leg_y", r6("corr"))


C6 = W + CORR + ", c AS (SELECT leg_x, leg_y, round(corr, 6) AS corr FROM cr)"
CS = C6 + ", " + i.SECTORS + ", cs AS (SELECT c.*, a.sector AS sector_x, b.sector AS sector_y, CASE WHEN a.sector = b.sector THEN 'Same Sector' ELSE 'Cross Sector' END AS bucket FROM c LEFT JOIN sec a ON a.ticker = leg_x LEFT JOIN sec b ON b.ticker = leg_y)"


def _cs(spark, d):
    return pairs.with_sectors(_corr(spark, d), i.sectors(spark, d))


@query("p5_correlation_band", C6 + " SELECT * FROM c WHERE corr BETWEEN 0.02 AND 0.2")
def _(spark, d):
    return pairs.band(_corr(spark, d), 0.02, 0.2)


@query("p6_absolute_correlation", C6 + " SELECT *, abs(corr) AS strength FROM c WHERE abs(corr) >= 0.05")
def _(spark, d):
    return _corr(spark, d).withColumn("strength", F.abs("corr")).where("strength >= 0.05")


@query("j3_sector_lookup", CS + " SELECT * FROM cs")
def _(spark, d):
    return _cs(spark, d)


@query("a3_bucket_summary", CS + " SELECT bucket, count(*) AS n_pairs, round(avg(corr), 3) AS mean_corr, round(min(corr), 3) AS min_corr, round(max(corr), 3) AS max_corr FROM cs GROUP BY bucket")
def _(spark, d):
    return pairs.bucket_summary(_cs(spark, d))


@query("p7_same_sector", CS + " SELECT * FROM cs WHERE sector_x = sector_y")
def _(spark, d):
    return _cs(spark, d).where("sector_x = sector_y")


@query("p8_same_index", C6 + ", ix AS (SELECT ticker, CASE WHEN n % 3 <> 0 THEN 'IX' || (n % 5) END AS tracks_index FROM (SELECT DISTINCT p_brand AS ticker, CAST(regexp_extract(p_brand, '\\d+') AS INT) AS n FROM part)) SELECT c.*, CASE WHEN a.tracks_index = b.tracks_index THEN 'same_index:' || a.tracks_index END AS reason FROM c LEFT JOIN ix a ON a.ticker = leg_x LEFT JOIN ix b ON b.ticker = leg_y")
def _(spark, d):
    n = F.regexp_extract("ticker", r"\d+", 0).cast("int")
    tracks = i.sectors(spark, d).select("ticker", F.when(n % 3 != 0, F.concat(F.lit("IX"), n % 5)).alias("tracks_index"))
    return pairs.index_reason(_corr(spark, d), tracks)


@query("p9_high_correlation", C6 + " SELECT *, CASE WHEN corr > 0.1 THEN 'high_corr:' || format('{:.4f}', corr) END AS reason FROM c")
def _(spark, d):
    return pairs.correlation_reason(_corr(spark, d), 0.1)


@query("p14_sector_lists", CS + " SELECT leg_x, leg_y, sector_x, sector_y FROM cs WHERE sector_x IN ('S1', 'S2', 'S3') AND sector_y IN ('S1', 'S2', 'S3') AND sector_x <> 'S3' AND sector_y <> 'S3'")
def _(spark, d):
    return pairs.include_sectors(_cs(spark, d), ["S1", "S2", "S3"], ["S3"]).select("leg_x", "leg_y", "sector_x", "sector_y")


@query("p15_blacklist", C6 + " SELECT * FROM c WHERE NOT (least(leg_x, leg_y) || greatest(leg_x, leg_y)) IN (SELECT 'Brand#1' || ticker FROM u)")
def _(spark, d):
    c = _corr(spark, d)
    return pairs.without(c, panels.positions(i.brand(spark, d)).select(F.col("ticker").alias("leg_x"), F.lit("Brand#1").alias("leg_y")))


US = W + ", " + i.SECTORS + ", us AS (SELECT u.*, sector FROM u JOIN sec USING (ticker))"


@query("u3_pairs_within_groups", US + " SELECT a.sector, a.ticker AS leg_x, b.ticker AS leg_y, a.pos AS pos_x, b.pos AS pos_y FROM us a JOIN us b ON a.sector = b.sector AND a.pos < b.pos")
def _(spark, d):
    return pairs.within_groups(panels.positions(i.brand(spark, d)).join(i.sectors(spark, d), "ticker"), "sector")


@query("u4_pair_counts", US + " SELECT sector, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS n_pairs FROM us GROUP BY sector")
def _(spark, d):
    return pairs.pair_counts(panels.positions(i.brand(spark, d)).join(i.sectors(spark, d), "ticker"), "sector")


@query("f9_first_group", "SELECT p_brand AS ticker, arg_min(p_type, p_partkey) AS sector FROM part GROUP BY p_brand")
def _(spark, d):
    return pairs.first_group(i.read(spark, d, "part").select(F.col("p_brand").alias("ticker"), F.col("p_type").alias("sector"), F.col("p_partkey").alias("pos")))


@query("u11_missing_tickers", "SELECT DISTINCT p_brand AS ticker FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 49)")
def _(spark, d):
    p = i.read(spark, d, "part")
    return p.select(F.col("p_brand").alias("ticker")).distinct().join(p.where("p_size > 49").select(F.col("p_brand").alias("ticker")).distinct(), "ticker", "left_anti")


@query("r6_bucket_counts", CS + " SELECT bucket, count(*) AS n FROM cs GROUP BY bucket")
def _(spark, d):
    return _cs(spark, d).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("r7_bucket_quantiles", CS + " SELECT bucket, round(quantile_cont(corr, 0.25), 6) AS q25, round(quantile_cont(corr, 0.5), 6) AS q50, round(quantile_cont(corr, 0.75), 6) AS q75 FROM cs GROUP BY bucket")
def _(spark, d):
    q = F.percentile("corr", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return _cs(spark, d).groupBy("bucket").agg(q.alias("q")).select("bucket", r6(F.col("q")[0], "q25"), r6(F.col("q")[1], "q50"), r6(F.col("q")[2], "q75"))


@query("a17_factor_correlation", i.TYPES + " SELECT leg_x, leg_y, round(CASE WHEN count(*) < 30 THEN 0.0 ELSE corr(rx, ry) END, 6) AS corr FROM (SELECT leg_x, leg_y, ln(x) - lag(ln(x)) OVER w AS rx, ln(y) - lag(ln(y)) OVER w AS ry FROM al WINDOW w AS (PARTITION BY leg_x, leg_y ORDER BY date)) GROUP BY ALL")
def _(spark, d):
    a = i.few(spark, d).withColumn("lx", F.log("x")).withColumn("ly", F.log("y"))
    r = a.withColumn("rx", windows.diff("lx")).withColumn("ry", windows.diff("ly"))
    return r.groupBy(*pairs.PAIR).agg(r6(F.when(F.count(F.lit(1)) < 30, 0.0).otherwise(F.corr("rx", "ry")), "corr"))
