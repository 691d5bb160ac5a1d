"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import math
import os

import duckdb
import pytest

from paneltide.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
#: A spread over all groups; the whole list runs with TEST_ALL=1.
SOME = ["a1_correlation_matrix", "x1_engle_granger", "x4_half_life", "w3_engine_zscore", "j4_asof_hedge", "w12_monthly_ols", "a5_trade_metrics", "j7_daily_pnl", "x17_cscv_pbo", "p3_fill_formation_gaps", "o2_pair_score"]
NAMES = sorted(catalog.ORACLES) if os.environ.get("TEST_ALL") else SOME


def norm(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "-"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = db.execute(catalog.ORACLES[name]).df()
    assert sorted(rows.columns) == columns
    want = sorted(tuple(map(norm, r)) for r in rows[columns].astype(object).where(rows[columns].notna(), None).itertuples(index=False))
    assert sorted(tuple(map(norm, r)) for r in got.select(*columns).toPandas().astype(object).itertuples(index=False)) == want


def test_flagship(spark):
    if os.path.isdir(SF):
        assert catalog.flagship(spark, SF).count() == 300
