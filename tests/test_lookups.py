"""Look-ups: windows as of a date, regions, names and lists."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from paneltide.operators import lookups
from paneltide.plans import catalog
from test_oracles import SF
from test_oracles import test_same_rows as same_rows

NAMES = ["p16_region_filter", "f10_sector_members", "f11_all_sector_tickers", "j8_requested_windows", "j9_results_as_of", "w20_change_since_entry", "f16_pair_names"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_queries(spark, name):
    same_rows(spark, name)
    assert catalog.QUERIES[name](spark, SF).limit(1).count() == 1


def test_latest(spark):
    d = datetime.date
    rows = spark.createDataFrame([("a", d(2020, 1, 1), 5.0), ("a", d(2020, 2, 1), None), ("b", d(2020, 1, 1), 3.0), ("c", d(2020, 3, 1), 1.0)], "leg_x string, window_date date, half_life double")
    assert [tuple(r) for r in lookups.latest(rows, ("leg_x",)).collect()] == [("c", d(2020, 3, 1), 1.0), ("b", d(2020, 1, 1), 3.0), ("a", d(2020, 2, 1), None)]
    assert [r["leg_x"] for r in lookups.latest(rows, ("leg_x",), "2020-01-31").collect()] == ["b", "a"]


def test_regions_without_one(spark):
    u = spark.createDataFrame([("A", "US"), ("B", None), ("C", "EU")], "ticker string, region string")
    names = lambda df: sorted(r["ticker"] for r in df.collect())
    assert (names(lookups.filter_regions(u)), names(lookups.filter_regions(u, exclude=["EU"])), names(lookups.filter_regions(u, ["US"]))) == (["A", "B", "C"], ["A", "B"], ["A"])


def test_texts(spark):
    row = spark.range(1).select(lookups.hedge_json(F.array(F.lit(1.23456), F.lit(-0.5))).alias("h")).first()
    assert row["h"] == "[1.2346,-0.5]"
    assert [lookups.parse_max_pairs(v) for v in (None, "all", " None ", "12", 3)] == [None, None, None, 12, 3]
