"""All queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import estimators, pairs
from . import inputs, q_lookups, q_panels, q_scans, q_series, q_trades  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of prices, hedge ratio and cointegration statistic of every pair of brands, on monthly prices."""
    rows = inputs.aligned(spark, sf_dir, "month")
    return pairs.correlation(rows).join(estimators.engle_granger(rows).drop("n_obs"), pairs.PAIR)
