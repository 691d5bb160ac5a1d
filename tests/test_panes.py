"""Windows merged from panes give what each window's rows give on their own."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneltide.operators import estimators, panes

DAY = datetime.date(2019, 8, 5)
SCHEMA = "leg_x string, leg_y string, date date, x double, y double"
BY = ("leg_x", "leg_y", "window")


def series(name, n, seed, flat=False):
    rng = np.random.default_rng(seed)
    y = 5 + 0.02 * rng.normal(size=n).cumsum()
    gap = np.zeros(n)
    for k in range(1, n):
        gap[k] = 0.7 * gap[k - 1] + 0.03 * rng.normal()
    x = 1 + 0.8 * y + (0 if flat else 1) * gap
    return [(name, "B", DAY + datetime.timedelta(days=k), float(math.exp(x[k])), float(math.exp(y[k]))) for k in range(n)]


def apart(spark, rows, spans):
    """Each window's rows under its own number, through the test of one series."""
    own = [(x, y, w, d, a, b) for (x, y, d, a, b), at in zip(rows, _places(rows), strict=True) for w, (low, high) in enumerate(spans[x]) if low <= at < high]
    df = spark.createDataFrame(own, "leg_x string, leg_y string, window long, date date, x double, y double")
    eg = estimators.engle_granger(df, by=BY)
    hl = estimators.half_life(estimators.spread(df, eg, by=BY), by=BY).select(*BY, "half_life")
    return {(r["leg_x"], r["window"]): r.asDict() for r in eg.join(hl, list(BY)).collect()}


def _places(rows):
    seen, out = {}, []
    for r in rows:
        out.append(seen.get(r[0], 0))
        seen[r[0]] = out[-1] + 1
    return out


def same(got, want):
    got = {(r["leg_x"], r["window"]): r.asDict() for r in got.collect()}
    assert got.keys() == want.keys() and got
    for key, w in want.items():
        for c in ("hedge", "intercept", "r2", "n_obs", "lag_used", "t_stat", "half_life"):
            assert got[key][c] == (w[c] if w[c] is None else pytest.approx(w[c], rel=1e-7, abs=1e-9)), (key, c)


@pytest.mark.parametrize("rows,step", [(60, 20), (50, 21), (40, 40), (35, 1), (31, 50)])
def test_rolling(spark, rows, step):
    data = series("A", 163, 1) + series("C", 90, 2) + series("short", 30, 3)
    spans = {x: [(k, k + rows) for k in range(0, n - rows + 1, step)] for x, n in (("A", 163), ("C", 90), ("short", 30))}
    same(panes.rolling(spark.createDataFrame(data, SCHEMA).repartition(5), rows, step), apart(spark, data, spans))


@pytest.mark.parametrize("n", [60, 101, 250])
def test_shares(spark, n):
    data = series("A", n, 4)
    size = math.floor(n * 0.6)
    step = (n - size) // 3
    same(panes.shares(spark.createDataFrame(data, SCHEMA)), apart(spark, data, {"A": [(w * step, w * step + size) for w in range(4)]}))


def test_prices_without_a_logarithm_are_rows_without_values(spark):
    data = series("A", 120, 5)
    for k in (0, 40, 41, 59, 60, 119):
        data[k] = (*data[k][:3], None if k % 2 else -1.0, data[k][4])
    got = panes.rolling(spark.createDataFrame(data, SCHEMA), 60, 20)
    want = apart(spark, data, {"A": [(k, k + 60) for k in range(0, 61, 20)]})
    same(got, want)


def test_legs_on_a_line_have_no_statistic_and_few_rows_no_window(spark):
    line = spark.createDataFrame(series("A", 100, 6, flat=True) + series("few", 20, 7), SCHEMA)
    got = panes.rolling(line, 50, 25).collect()
    assert [r["window"] for r in sorted(got, key=lambda r: r["window"])] == [0, 1, 2]
    assert all(r["t_stat"] is None and r["half_life"] is None and r["hedge"] == pytest.approx(0.8) for r in got)
    assert panes.rolling(line.where("false"), 50, 25).count() == 0 == panes.month_ends(line.where("false"), 6).count()


def test_month_ends(spark):
    data = series("A", 420, 8)
    got = {r["date"]: r for r in panes.month_ends(spark.createDataFrame(data, SCHEMA), 6, 30).collect()}
    ends = spark.range(16).select(F.last_day(F.add_months(F.lit(DAY), F.col("id").cast("int"))).alias("e")).select("e", F.add_months("e", -6).alias("s")).collect()
    want = 0
    for e, s in ends:
        own = [(math.log(a), math.log(b)) for _, _, d, a, b in data if s < d <= e]
        if len(own) < 30 or e.replace(day=1) > data[-1][2]:
            assert e not in got
            continue
        want += 1
        slope, intercept = np.polyfit([b for _, b in own], [a for a, _ in own], 1)
        assert got[e]["n_obs"] == len(own) and got[e]["hedge"] == pytest.approx(slope) and got[e]["intercept"] == pytest.approx(intercept)
    assert len(got) == want >= 12


def test_one_shuffle_from_rows_to_windows(spark):
    rows = spark.createDataFrame(series("A", 100, 9), SCHEMA)
    plan = panes.rolling(rows, 50, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_trailing_hedge(spark):
    data = series("A", 100, 10)
    r = estimators.trailing_hedge(spark.createDataFrame(data, SCHEMA), 63).first()
    slope, intercept = np.polyfit([math.log(b) for *_, b in data[-63:]], [math.log(a) for *_, a, _ in data[-63:]], 1)
    assert r["n_obs"] == 63 and r["date"] == data[-1][2] and r["hedge"] == pytest.approx(slope) and r["intercept"] == pytest.approx(intercept)


def test_whole_series(spark):
    data = series("A", 150, 11) + series("C", 90, 12)
    df = spark.createDataFrame(data, SCHEMA)
    got = {r["leg_x"]: r for r in panes.whole(df).collect()}
    eg = estimators.engle_granger(df)
    spread = estimators.spread(df, eg)
    own = eg.join(estimators.half_life(spread).select("leg_x", "half_life"), "leg_x").join(estimators.spread_summary(spread), "leg_x").join(estimators.snr(spread), "leg_x")
    for w in own.collect():
        for c in ("hedge", "intercept", "r2", "n_obs", "lag_used", "t_stat", "half_life", "spread_mean", "spread_std", "snr"):
            assert got[w["leg_x"]][c] == pytest.approx(w[c], rel=1e-7), c
        x, y = (np.diff(np.log([r[k] for r in data if r[0] == w["leg_x"]])) for k in (3, 4))
        assert got[w["leg_x"]]["return_corr"] == pytest.approx(np.corrcoef(x, y)[0, 1])
