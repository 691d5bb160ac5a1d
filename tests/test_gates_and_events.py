"""The gates of a cointegrated pair, the rolling filter's reasons, and daily profit from entries and exits."""

import datetime
import random

import pytest

from paneltide.operators import trades, validation
from tests.test_panes import SCHEMA, series

DAY = datetime.date(2021, 3, 1)


def test_gates_name_the_first_that_fails(spark):
    rng = random.Random(3)
    apart, p, q = [], 0.0, 0.0
    for k in range(200):
        p, q = p + rng.gauss(0, 0.02), q + rng.gauss(0, 0.02)
        apart.append(("apart", "B", DAY + datetime.timedelta(days=k), 2.718281828**p, 2.718281828**q))
    rows = spark.createDataFrame(series("good", 300, 1) + series("few", 59, 2) + apart, SCHEMA)
    got = {r["leg_x"]: r for r in validation.cointegrated(rows, low=0.5).collect()}
    assert got["good"]["reason"] is None and got["few"]["reason"] == "rows" and got["apart"]["reason"] == "pvalue"
    assert got["few"]["hedge"] is None and got["few"]["n_obs"] == 59
    assert got["good"]["spread_mean"] == pytest.approx(0, abs=1e-9)
    slow = {r["leg_x"]: r["reason"] for r in validation.cointegrated(rows, low=25.0).collect()}
    assert slow["good"] == "half_life"
    assert validation.cointegrated(rows.where("false")).count() == 0


def test_rolling_reasons(spark):
    rows = spark.createDataFrame(series("good", 300, 1) + series("short", 90, 2), SCHEMA)
    found = rows.select("leg_x", "leg_y").distinct()
    reason = lambda t, share: {r["leg_x"]: r["rolling_reason"] for r in validation.rolling_reason(found, rows, t, 50.0, share, 100, 50).collect()}
    assert reason(0.0, 0.7) == {"good": None, "short": "rolling_no_windows"}
    assert reason(-50.0, 0.7) == {"good": "rolling_consistency:0%<70%", "short": "rolling_no_windows"}


def plain(rows, days):
    return {(s, d): sum(p / h / 7 for s2, a, b, h, p in rows if s2 == s and h and h > 0 and a and b and a <= d <= b) for s in {r[0] for r in rows} for d in days}


def test_daily_profit_by_events(spark):
    rng = random.Random(5)
    day = lambda k: DAY + datetime.timedelta(days=k)
    rows = [(rng.choice("AB"), day(a := rng.randrange(60)), day(a + (h := rng.randrange(1, 15))), h, rng.uniform(-900, 900)) for _ in range(300)]
    rows += rows[:5] + [("A", day(9), day(4), 3, 50.0), ("A", day(1), None, 3, 50.0), ("B", day(1), day(3), 0, 50.0), ("C", day(1), day(1), None, 1.0)]
    df = spark.createDataFrame(rows, "strategy string, entry_date date, exit_date date, holding_days int, pnl double")
    days = [day(k) for k in range(-3, 90) if k % 7 not in (5, 6)]
    calendar = spark.createDataFrame([(d,) for d in days], "date date")
    want = plain(rows, days)
    got = {(r["strategy"], r["date"]): r["ret"] for r in trades.daily_pnl(df, calendar, ("strategy",), 7.0).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-10) for k in want)
    assert all(got["A", d] == 0.0 for d in days if d > day(80))
    one = {r["date"]: r["ret"] for r in trades.daily_pnl(df, calendar, capital=7.0).collect()}
    assert one == pytest.approx({d: want["A", d] + want["B", d] for d in days}, abs=1e-10)
    assert {r["ret"] for r in trades.daily_pnl(df.where("false"), calendar).collect()} == {0.0}
