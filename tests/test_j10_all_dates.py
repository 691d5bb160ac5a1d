"""Every order date is answered. Brute force, beside the SQL."""

import os

import pytest
from pyspark.sql import functions as F

from paneltide.operators import lookups, panels
from paneltide.plans import catalog, inputs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_nearest_date_of_all_orders(spark):
    asked = {r[0] for r in inputs.read(spark, SF, "orders").select(F.to_date("o_orderdate")).distinct().collect()}
    days = [r["date"] for r in panels.calendar(inputs.types(spark, SF)).collect()]
    near = {q: min((abs((c - q).days), c) for c in days) for q in asked}
    got = {r["q"]: r["date"] for r in catalog.QUERIES["j10_nearest_date"](spark, SF).collect()}
    assert got == {str(q): str(x[1]) for q, x in near.items()} and len(got) > 100


def test_far_dates_ties_and_no_days(spark):
    day = lambda n: f"20{n:02d}-01-01"
    asked = spark.createDataFrame([(day(1),), ("2010-01-03",), ("2010-01-04",), (day(60),), (None,), (day(1),)], "q string").select(F.col("q").cast("date").alias("q"))
    days = spark.createDataFrame([("2010-01-02",), ("2010-01-05",), ("2010-01-02",)], "date string").select(F.col("date").cast("date").alias("date"))
    got = {str(r["q"]): str(r["date"]) for r in lookups.nearest(asked, days).collect()}
    assert got == {day(1): "2010-01-02", "2010-01-03": "2010-01-02", "2010-01-04": "2010-01-05", day(60): "2010-01-05"}
    assert {r["date"] for r in lookups.nearest(asked, days.where("false")).collect()} == {None}
    middle = spark.sql("SELECT DATE'2010-01-03' AS q"), spark.sql("SELECT EXPLODE(ARRAY(DATE'2010-01-01', DATE'2010-01-05')) AS date")
    assert str(lookups.nearest(*middle).first()["date"]) == "2010-01-01"
