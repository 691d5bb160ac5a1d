"""Price files: wide CSV in and out, landing folders, metadata and configuration files, result folders."""

from __future__ import annotations

import json
from dataclasses import asdict, is_dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import panels


class ConfigError(ValueError):
    """A configuration that is missing, no mapping, or has unknown keys."""


def read_wide_csv(spark: SparkSession, path: str, date_column: str | None = None) -> DataFrame:
    """A wide CSV (a date column, then one of prices for each ticker) as a long panel; the first of equal dates counts.

    Columns are named by the header and read as text, so that no pass infers types."""
    raw = spark.read.csv(path, header=True)
    first = date_column or raw.columns[0]
    tickers = [c for c in raw.columns if c != first]
    if not tickers:
        raise ConfigError(f"no price columns in {path}")
    numbered = raw.withColumn("__n", F.monotonically_increasing_id())
    long = numbered.unpivot([first, "__n"], tickers, "ticker", "px").withColumnRenamed(first, "date")
    typed = long.select("date", F.upper(F.trim("ticker")).alias("ticker"), F.col("px").try_cast("double").alias("px"), "__n")
    return panels.sanitise(typed, "__n").where("px IS NOT NULL AND NOT isnan(px)")


def price_frame(spark: SparkSession, path: str, tickers: list[str] | None = None, min_prices: int = 252, method: str = "log", allow_missing: bool = False) -> DataFrame:
    """read_wide_csv, the tickers asked for, without the sparse ones, with returns."""
    panel = read_wide_csv(spark, path)
    if tickers:
        panel = panels.select_tickers(panel, tickers, allow_missing)
    return panels.returns(panels.drop_sparse(panel, min_prices), method)


def landing(spark: SparkSession, path: str, schema: str = "date date, ticker string, px double") -> DataFrame:
    """Files that a downloader leaves in a folder, batch by batch, as one long panel."""
    return spark.read.schema(schema).parquet(path)


def failed_tickers(panel: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of the tickers asked for, those without any price."""
    return wanted.select("ticker").distinct().join(panel.where("px IS NOT NULL").select("ticker").distinct(), "ticker", "left_anti")


def write_wide_csv(panel: DataFrame, path: str, tickers: list[str]) -> None:
    panels.pivot(panel, tickers).orderBy("date").write.mode("overwrite").csv(path, header=True)


TRADE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("pair", "leg_x", "leg_y", "sector", "direction")]
    + [T.StructField(c, T.DateType()) for c in ("entry_date", "exit_date")]
    + [T.StructField("holding_days", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in ("entry_z", "exit_z", "exit_z_rolling", "hedge_ratio", "half_life", "pnl")]
    + [T.StructField("exit_reason", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("capital_at_entry", "qty_x", "qty_y", "entry_px", "entry_py")]
)


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    """A trade log of any generation: columns by name, those that it lacks null; trade_seq keeps the rows' order."""
    raw = spark.read.csv(path, header=True)
    have = set(raw.columns)
    columns = [(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in TRADE_SCHEMA.fields]
    return raw.select(F.monotonically_increasing_id().alias("trade_seq"), *columns).withColumn("trading_year", F.year("entry_date"))


def write_run(trades: DataFrame, summary: DataFrame, config, metrics: dict, path: str) -> None:
    """trades and summary as Parquet, the configuration and metrics as one row of JSON each."""
    trades.write.mode("overwrite").parquet(f"{path}/trades")
    summary.write.mode("overwrite").parquet(f"{path}/summary")
    spark = trades.sparkSession
    for name, value in (("config", asdict(config) if is_dataclass(config) else dict(config)), ("metrics", metrics)):
        spark.createDataFrame([(json.dumps(value, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def read_yaml(path: str) -> dict:
    import yaml

    file = Path(path)
    if not file.exists():
        raise ConfigError(f"no such file: {path}")
    try:
        data = yaml.safe_load(file.read_text())
    except yaml.YAMLError as error:
        raise ConfigError(f"{path}: {error}") from error
    if not isinstance(data, dict):
        raise ConfigError(f"{path} is no mapping")
    return data


METADATA = ("name", "sector", "category", "region", "issuer", "expense_ratio", "benchmark", "inception", "tracks_index")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The dimension of tickers of a metadata file's `etfs`."""
    rows = []
    for ticker, fields in read_yaml(path).get("etfs", {}).items():
        value = lambda c: None if fields.get(c) is None else float(fields[c]) if c == "expense_ratio" else str(fields[c])  # noqa: B023, E731
        rows.append((str(ticker).upper(), *[value(c) for c in METADATA]))
    schema = "ticker string, " + ", ".join(f"{c} {'double' if c == 'expense_ratio' else 'string'}" for c in METADATA)
    return spark.createDataFrame(rows, schema)


def resolve_universe(config: dict, name: str | None = None) -> list[str]:
    """The tickers of a named list: its own, and those of its categories, in order and once each."""
    universe = config.get("universe", config)
    name = name or universe.get("default_list")
    entry = universe.get("lists", {}).get(name)
    if entry is None:
        raise ConfigError(f"no list {name}")
    found = [*entry.get("tickers", []), *entry.get("etfs", [])]
    for c in entry.get("categories", []):
        found += universe.get("categories", {}).get(c, {}).get("etfs", [])
    found = list(dict.fromkeys(str(t).strip().upper() for t in found))
    if not found:
        raise ConfigError(f"list {name} is empty")
    return found


#: Former names of configuration keys.
ALIASES = {"entry_zscore": "entry_sigma", "exit_zscore": "exit_sigma", "stop_loss_zscore": "stop_sigma", "entry_threshold_sigma": "entry_sigma", "exit_threshold_sigma": "exit_sigma", "stop_loss_sigma": "stop_sigma", "zscore_lookback": "lookback", "use_fixed_exit_params": "fixed_exit", "exit_tolerance_sigma": "exit_tolerance", "initial_capital": "capital"}


def read_rules(path: str):
    """Simulation rules of a configuration file; unknown keys are named in the error."""
    from ..operators.simulation import Rules

    data = read_yaml(path)
    data = {ALIASES.get(k, k): v for k, v in data.get("backtest", data).items()}
    unknown = sorted(set(data) - set(Rules.__dataclass_fields__))
    if unknown:
        raise ConfigError(f"unknown keys: {', '.join(unknown)}")
    return Rules(**data)
