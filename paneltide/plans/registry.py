"""Registers queries under a name with the SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: str = ""):
    """dates: the result's DATE columns; both sides give them as text, so that they compare alike in any client."""
    names = dates.split()

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.withColumns({c: F.col(c).cast("string") for c in names}) if names else out

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in names)}) FROM ({sql})" if names else sql
        return f

    return put


def r6(c: str | Column, name: str | None = None) -> Column:
    """Rounded to six digits, as all results that are sums of doubles are compared."""
    column = F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)  # no negative zero
    return column.alias(name or c) if name or isinstance(c, str) else column
