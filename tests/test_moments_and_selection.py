"""Co-moment blocks, running drawdown by ranges, and selection in rounds, against plain Python."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneltide.operators import comoments, pairs, windows


def panel(spark, n, days, seed, holes=0.2):
    rng = np.random.default_rng(seed)
    v = 100 + rng.normal(size=(days, n)).cumsum(axis=0)
    v[rng.random((days, n)) < holes] = np.nan
    v[:, 0] = 7.0
    first = datetime.date(1969, 12, 1)
    rows = [(f"T{j}", j, first + datetime.timedelta(days=i), None if math.isnan(v[i, j]) and (i + j) % 2 else float(v[i, j])) for i in range(days) for j in range(n)]
    return v, spark.createDataFrame(rows, "ticker string, pos int, date date, px double")


@pytest.mark.parametrize("block,span", [(3, 7), (64, 128)])
def test_all_pairs(spark, block, span):
    v, df = panel(spark, 8, 60, 1)
    got = {(r["leg_x"], r["leg_y"]): r for r in comoments.correlation(df, "px", block, span).collect()}
    assert len(got) == 28
    for i in range(8):
        for j in range(i + 1, 8):
            both = ~np.isnan(v[:, i]) & ~np.isnan(v[:, j])
            r = got[f"T{i}", f"T{j}"]
            assert r["n_obs"] == both.sum()
            assert r["corr"] is None if i == 0 else r["corr"] == pytest.approx(np.corrcoef(v[both, i], v[both, j])[0, 1], abs=1e-10)


def test_no_common_dates_and_no_rows(spark):
    day = datetime.date(2020, 1, 1)
    apart = spark.createDataFrame([("A", 0, day, 1.0), ("B", 1, day + datetime.timedelta(days=1), 2.0)], "ticker string, pos int, date date, px double")
    assert comoments.correlation(apart).count() == 0 and comoments.correlation(apart.where("false")).count() == 0
    one = spark.createDataFrame([("A", 0, day, 1.0), ("B", 1, day, 2.0)], apart.schema)
    assert [(r["corr"], r["n_obs"]) for r in comoments.correlation(one).collect()] == [(None, 1)]


def test_no_pair_by_date_join(spark):
    _, df = panel(spark, 4, 10, 2)
    plan = comoments.correlation(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "(date#" not in "".join(line for line in plan.splitlines() if "Join" in line)


@pytest.mark.parametrize("by", [(), ("k",)])
def test_drawdown_by_ranges(spark, by):
    rng = np.random.default_rng(5)
    rows = [(int(i), ["a", None][i % 2], float(x)) for i, x in zip(rng.permutation(300) - 40, rng.normal(size=300).round(3))]
    df = spark.createDataFrame(rows, "trade_seq long, k string, pnl double")
    got = {r["trade_seq"]: r for r in windows.drawdown(df, "pnl", by, width=17).collect()}
    assert len(got) == 300
    for group in ({"a", None},) if not by else ({"a"}, {None}):
        cum, top = 0.0, -math.inf
        for seq, _, x in sorted((r for r in rows if r[1] in group), key=lambda r: r[0]):
            cum += x
            top = max(top, cum)
            assert got[seq]["cum"] == pytest.approx(cum) and got[seq]["drawdown"] == pytest.approx(top - cum, abs=1e-9)


def walk(rows, per_sector, per_ticker, most):
    out = []
    for key in {r[0] for r in rows}:
        sectors, legs, n = {}, {}, 0
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (-r[4], r[1], r[2])):
            if n < most and sectors.get(r[3], 0) < per_sector and max(legs.get(r[1], 0), legs.get(r[2], 0)) < per_ticker:
                n += 1
                out.append((*r[:3], n))
                sectors[r[3]] = sectors.get(r[3], 0) + 1
                for x in r[1:3]:
                    legs[x] = legs.get(x, 0) + 1
    return sorted(out)


@pytest.mark.parametrize("caps", [(2, 1, 50), (5, 2, 10), (100, 3, 4)])
def test_rounds_take_what_a_walk_takes(spark, caps):
    rng = np.random.default_rng(sum(caps))
    rows = [(year, f"T{i:02d}", f"T{j:02d}", f"S{i % 3}", float(rng.integers(0, 9))) for year in (1, 2) for i in range(14) for j in range(i + 1, 14)]
    df = spark.createDataFrame(rows, "year int, leg_x string, leg_y string, sector string, score double").withColumn("extra", F.lit(1))
    got = pairs.greedy_diversified(df, ["year"], *caps)
    assert sorted((r["year"], r["leg_x"], r["leg_y"], r["rank"]) for r in got.collect()) == walk(rows, *caps)
    assert pairs.greedy_diversified(df.where("false"), ["year"], *caps).count() == 0
