"""A live twin of the panel: prices that arrive in a folder, averaged by window with late data dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str = "ts timestamp, ticker string, px double") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def bars(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Mean price and number of ticks of each ticker and window."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "ticker").agg(F.avg("px").alias("px"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("ts"), "ticker", "px", "n")
