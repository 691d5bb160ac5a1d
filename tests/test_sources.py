"""Files in and out."""

import pytest

from paneltide.operators.simulation import Rules
from paneltide.sources import prices


def test_wide_csv(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text("Date,aaa,BBB\n2020-01-02,1.5,\n2020-01-01,1.0,2.0\n2020-01-02,9,9\nbad,1,1\n")
    got = {(str(r["date"]), r["ticker"]): r["px"] for r in prices.read_wide_csv(spark, str(f)).collect()}
    assert got == {("2020-01-02", "AAA"): 1.5, ("2020-01-01", "AAA"): 1.0, ("2020-01-01", "BBB"): 2.0}
    prices.write_wide_csv(prices.read_wide_csv(spark, str(f)), str(tmp_path / "out"), ["AAA", "BBB"])
    assert prices.read_wide_csv(spark, str(tmp_path / "out")).count() == 3


def test_trade_logs_of_two_generations(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("pair,leg_x,leg_y,entry_date,exit_date,holding_days,pnl,exit_reason\nA_B,A,B,2020-01-01,2020-01-05,4,1.25,convergence\n")
    r = prices.read_trades(spark, str(f)).first()
    assert r["pnl"] == 1.25 and r["qty_x"] is None and r["trading_year"] == 2020


def test_configuration(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("backtest:\n  entry_zscore: 2.5\n  max_positions: 3\n")
    assert prices.read_rules(str(f)) == Rules(entry_sigma=2.5, max_positions=3)
    f.write_text("nonsense: 1\n")
    with pytest.raises(prices.ConfigError):
        prices.read_rules(str(f))
    with pytest.raises(prices.ConfigError):
        prices.read_yaml(str(tmp_path / "none.yaml"))
    u = {"universe": {"lists": {"x": {"tickers": ["b "], "categories": ["c"]}}, "categories": {"c": {"etfs": ["A", "B"]}}, "default_list": "x"}}
    assert prices.resolve_universe(u) == ["B", "A"]
