"""Every order has a row, halfway values too. Brute force, beside the SQL."""

import os

import pytest
from pyspark.sql import functions as F

from paneltide.functions import scalars
from paneltide.plans import catalog, inputs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_one_digit_is_pythons(spark):
    values = [k / 100 for k in range(12_000)] + [-k / 100 for k in range(1, 300)] + [k / 4 + e for k in range(40) for e in (1e-15, 1e-9)] + [2.0**45 + 0.25, 1e13 + 0.75]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", scalars.one_digit(F.col("v")).alias("t")).collect()
    assert [(r["v"], r["t"]) for r in rows if r["t"] != f"{r['v']:.1f}"] == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_reasons_of_all_orders(spark):
    def reason(h, a, b):
        if h % 9 == 0:
            return "pvalue:None"
        if h % 9 == 8:
            return "pvalue:0.5"
        if h % 7 == 0:
            return "half_life:None"
        return f"half_life_low:{a:.1f}" if a < 5 else f"half_life_high:{a:.1f}" if a > 60 else f"spread_range_low:{b:.1f}" if b < 4 else None

    orders = inputs.read(spark, SF, "orders").selectExpr("o_orderkey AS k", "CAST(o_totalprice AS DOUBLE) AS p").collect()
    got = {r["k"]: r["reason"] for r in catalog.QUERIES["p10_excluded_reasons"](spark, SF).collect()}
    assert got == {r["k"]: reason(r["k"] % 40, r["p"] % 97, r["p"] % 13) for r in orders}
