"""Estimators, filters and the simulation against plain numpy on made-up series."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneltide.functions import scalars
from paneltide.operators import cscv, estimators, kalman, pairs, panels, signals, simulation, trades, windows

DAYS = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(400)]


def pair_frame(spark, x, y):
    rows = [("A", "B", d, float(a), float(b)) for d, a, b in zip(DAYS, x, y)]
    return spark.createDataFrame(rows, "leg_x string, leg_y string, date date, x double, y double")


def ar1(phi, n=400, sd=0.1, seed=42):
    e = np.random.default_rng(seed).normal(0, sd, n)
    s = np.zeros(n)
    for t in range(1, n):
        s[t] = phi * s[t - 1] + e[t]
    return s


def series(spark, s):
    return spark.createDataFrame([("A", "B", d, float(v) if v == v else None) for d, v in zip(DAYS, s)], "leg_x string, leg_y string, date date, spread double")


def test_half_life_of_ar1(spark):
    hl = estimators.half_life(series(spark, ar1(0.9))).first()
    assert hl["half_life"] == pytest.approx(-math.log(2) / math.log(0.9), rel=0.5)
    s = ar1(0.9)
    b, a = np.polyfit(s[:-1], np.diff(s), 1)
    assert hl["slope"] == pytest.approx(b) and hl["intercept"] == pytest.approx(a)


def test_half_life_edge_cases(spark):
    assert estimators.half_life(series(spark, np.ones(100))).first()["half_life"] is None
    assert estimators.half_life(series(spark, 1.05 ** np.arange(100.0))).first()["half_life"] is None
    assert estimators.half_life(series(spark, ar1(0.9)[:20])).first()["half_life"] is None
    gaps = ar1(0.9)
    gaps[[10, 50, 100]] = np.nan
    assert estimators.half_life(series(spark, gaps)).first()["half_life"] > 0


def test_ou(spark):
    got = estimators.ou(series(spark, ar1(0.9))).first()
    assert got["theta"] == pytest.approx(-math.log(got["beta"])) and got["sigma"] > 0


def test_engle_granger_finds_the_pair(spark):
    rng = np.random.default_rng(0)
    y = np.exp(np.cumsum(rng.normal(0, 0.01, 400)) + 4)
    x = y**0.8 * np.exp(rng.normal(0, 0.01, 400))
    got = estimators.with_pvalue(estimators.engle_granger(pair_frame(spark, x, y))).first()
    assert got["hedge"] == pytest.approx(0.8, abs=0.05) and got["pvalue"] < 0.01
    z = np.exp(np.cumsum(rng.normal(0, 0.01, 400)) + 4)
    assert estimators.with_pvalue(estimators.engle_granger(pair_frame(spark, z, y))).first()["pvalue"] > 0.05


def test_pvalue_surface():
    assert scalars.coint_pvalue(-3.33613) == pytest.approx(0.05, abs=2e-3)
    assert scalars.coint_pvalue(-3.89644) == pytest.approx(0.01, abs=1e-3)
    assert scalars.coint_pvalue(scalars.coint_threshold(0.05)) == pytest.approx(0.05, abs=1e-6)
    assert scalars.coint_critical(250)[1] == pytest.approx(-3.36, abs=0.01)


def test_johansen_rank():
    rng = np.random.default_rng(1)
    w = np.cumsum(rng.normal(0, 0.01, 600))
    data = np.stack([w + rng.normal(0, 0.01, 600), w + rng.normal(0, 0.01, 600), np.cumsum(rng.normal(0, 0.01, 600))], axis=1)
    trace, values, first = estimators.johansen_of(data)
    assert trace[0] > estimators.JOHANSEN_95[2] and trace[1] < estimators.JOHANSEN_99[1]
    assert first[0] == 1 and first[1] == pytest.approx(-1, abs=0.1)


def test_kalman_follows_the_hedge(spark):
    rng = np.random.default_rng(3)
    y = np.exp(np.cumsum(rng.normal(0, 0.02, 400)) + 3)
    x = y**1.5 * np.exp(rng.normal(0, 0.005, 400))
    rows = kalman.kalman_hedge(pair_frame(spark, x, y)).orderBy("date").collect()
    assert len(rows) == 400 and rows[-1]["hedge"] == pytest.approx(1.5, abs=0.2)
    assert kalman.kalman_engine(pair_frame(spark, x, y)).count() == 400
    assert kalman.kalman_hedge(pair_frame(spark, x[:20], y[:20])).count() == 0


def test_adaptive_zscore_is_the_plain_one(spark):
    s = series(spark, ar1(0.9)).withColumn("n", F.lit(40))
    a = windows.adaptive_zscore(s, "spread", "n", 30, 60).orderBy("date").toPandas().z
    b = windows.zscore(series(spark, ar1(0.9)), lookback=40, least=30).orderBy("date").toPandas().z
    pd.testing.assert_series_equal(a, b, check_names=False, atol=1e-9)


def test_signals_walk():
    z = [0, -2.5, -2.2, 0.1, 0.2, 2.4, 2.2, -0.1, float("nan"), None]
    fixed = signals.walk(z, list(range(10)), corrected=True)
    assert [(r[0], r[1]) for r in fixed] == [(1, "entry"), (3, "exit"), (5, "entry"), (7, "exit")]
    published = signals.walk(z, list(range(10)))
    assert (2, "exit") in [(r[0], r[1]) for r in published]


def test_simulation_profit_and_costs():
    n = 120
    z = [0.0] * n
    z[80], z[90] = -2.5, 0.0
    z[81:90] = [-2.5] * 9
    frame = pd.DataFrame({"rank": 0, "leg_x": "A", "leg_y": "B", "date": DAYS[:n], "x": [100.0] * 90 + [110.0] * 30, "y": 50.0, "hedge": 1.0, "half_life": 10.0, "spread": z, "mu": 0.0, "sigma": 1.0, "z": z})
    out = simulation.simulate_group(frame, simulation.Rules(fixed_exit=False, regime_break=False, max_holding_days=500, time_based_stops=False, stop_sigma=9, cost_bps=0))
    assert len(out) == 1 and out[0]["direction"] == "LONG" and out[0]["exit_reason"] == "convergence"
    assert out[0]["pnl"] == pytest.approx(5_000 / 100 * 10)
    paid = simulation.simulate_group(frame, simulation.Rules(fixed_exit=False, regime_break=False, max_holding_days=500, time_based_stops=False, stop_sigma=9, cost_bps=10))
    assert paid[0]["pnl"] == pytest.approx(500 - (10_000 + 10_500) * 1e-3)


def test_simulation_needs_a_warm_up(spark):
    assert simulation.simulate_group(pd.DataFrame({"rank": 0, "leg_x": "A", "leg_y": "B", "date": DAYS[:40], "x": 1.0, "y": 1.0, "hedge": 1.0, "half_life": 5.0, "spread": 0.0, "mu": 0.0, "sigma": 1.0, "z": 9.0}), simulation.Rules()) == []


def test_cscv(spark):
    rng = np.random.default_rng(42)
    rows = [(f"s{k}", d, float(v)) for k in range(8) for d, v in zip(DAYS, rng.normal(0.003 if k == 3 else 0.0, 0.005, 400))]
    r = spark.createDataFrame(rows, "strategy string, date date, ret double")
    a = cscv.analyse(r, 8).first()
    assert a["n_combinations"] == 70 and a["pbo"] == 0.0 and a["n_strategies"] == 8
    with pytest.raises(ValueError):
        cscv.splits(spark, 7)


def test_deflated_sharpe_falls_with_trials():
    assert scalars.deflated_sharpe(1.0, 1) == (1.0, 0.0)
    assert scalars.deflated_sharpe(1.0, 10)[0] > scalars.deflated_sharpe(1.0, 1000)[0]
    assert scalars.optimal_threshold() == pytest.approx(0.7518, abs=1e-3)


def test_greedy_caps(spark):
    rows = [(2000, "A", "B", "S", 0.9), (2000, "A", "C", "S", 0.8), (2000, "A", "D", "S", 0.7), (2000, "E", "F", "S", 0.6), (2000, "G", "H", "T", 0.5)]
    df = spark.createDataFrame(rows, "trading_year int, leg_x string, leg_y string, sector string, score double")
    got = [(r["leg_x"], r["leg_y"]) for r in pairs.greedy_diversified(df, ["trading_year"], 3, 2, 3).orderBy("rank").collect()]
    assert got == [("A", "B"), ("A", "C"), ("E", "F")]


def test_panel_edges(spark):
    p = spark.createDataFrame([("A", DAYS[0], 1.0), ("A", DAYS[2], 2.0), ("B", DAYS[1], 5.0)], "ticker string, date date, px double")
    full = {(r["ticker"], r["date"]): r["px"] for r in panels.fill(panels.complete(p)).collect()}
    assert full[("A", DAYS[1])] == 1.0 and full[("B", DAYS[0])] == 5.0 and len(full) == 6
    with pytest.raises(panels.PanelError):
        panels.select_tickers(p, ["NONE"])
    with pytest.raises(ValueError):
        panels.returns(p, "odd")


def test_metrics_without_losses(spark):
    t = spark.createDataFrame([(0, 5.0, 3), (1, 1.0, 2)], "trade_seq int, pnl double, holding_days int")
    m = trades.metrics(t).first()
    assert m["profit_factor"] == float("inf") and m["max_drawdown"] == 0.0


def test_month_windows():
    w = windows.month_windows("2020-01-31", "2022-12-31")
    assert w[0][1:3] == (dt.date(2020, 1, 31), dt.date(2021, 1, 31)) and len(w) == 3
