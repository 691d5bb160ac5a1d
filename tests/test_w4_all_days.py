"""All days have a score. Brute force, beside the SQL."""

import datetime
import math
import os
import statistics

import pytest

from paneltide.plans import catalog, q_series

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_adaptive_zscore_of_all_days(spark, monkeypatch):
    values = {("A", "BB"): [math.sin(k) + k % 7 for k in range(420)], ("CCC", "D"): [math.cos(k * k) for k in range(350)]}
    day = lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(days=k)
    rows = [(x, y, day(k), v) for (x, y), vs in values.items() for k, v in enumerate(vs)]
    monkeypatch.setattr(q_series, "_spread", lambda spark, d: spark.createDataFrame(rows, "leg_x string, leg_y string, date date, spread double"))
    got = {(r["leg_x"], r["leg_y"], r["date"]): r["z"] for r in catalog.QUERIES["w4_adaptive_zscore"](spark, SF).collect()}
    assert len(got) == 770
    for (x, y), vs in values.items():
        n = 30 + (len(x) * 7 + len(y)) % 30
        for k, v in enumerate(vs):
            own = vs[max(0, k - n + 1) : k + 1]
            want = (v - statistics.fmean(own)) / statistics.stdev(own) if len(own) >= 30 else None
            assert got[x, y, str(day(k))] == (want if want is None else pytest.approx(want, abs=2e-6))
