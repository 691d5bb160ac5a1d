"""The position state machine over z-scores, and its summary."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import BY


def walk(z: list, dates: list, entry: float = 2.0, exit_: float = 0.5, most_days: int | None = None, mean_cross: bool = True, corrected: bool = False) -> list[tuple]:
    """(date, action, position, z, reason) of each entry and exit. Missing scores change nothing.

    mean_cross closes a long position at z <= 0 and a short one at z >= 0, as the method is published; `corrected` turns
    that round. A bar may close a position and open another."""
    position, since, out = 0, 0, []
    for i, value in enumerate(z):
        if value is None or value != value:
            continue
        if position:
            crossed = mean_cross and ((value <= 0) == (position > 0) if not corrected else (value >= 0) == (position > 0))
            reason = "mean_cross" if crossed or (mean_cross and value == 0) else "exit_threshold" if abs(value) <= exit_ else "timeout" if most_days and i - since >= most_days else None
            if reason:
                out.append((dates[i], "exit", position, value, reason))
                position = 0
        if not position and abs(value) >= entry:
            position, since = (1 if value <= -entry else -1), i
            out.append((dates[i], "entry", position, value, "entry"))
    return out


def signals(scores: DataFrame, by: tuple[str, ...] = BY, **how) -> DataFrame:
    """Rows of walk() for each series of (date, z)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        rows = walk(pdf.z.tolist(), pdf.date.tolist(), **how)
        out = pd.DataFrame(rows, columns=["date", "action", "position", "z", "reason"])
        for c in reversed(by):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    return scores.select(*by, "date", "z").groupBy(*by).applyInPandas(run, ", ".join(f"{c} string" for c in by) + ", date date, action string, position int, z double, reason string")


def summary(rows: DataFrame) -> DataFrame:
    """Counts of entries, exits, long and short entries."""
    n = lambda cond, name: F.sum(F.when(cond, 1).otherwise(0)).alias(name)
    entry = F.col("action") == "entry"
    return rows.agg(F.count(F.lit(1)).alias("total_signals"), n(entry, "entries"), n(~entry, "exits"), n(entry & (F.col("position") > 0), "long"), n(entry & (F.col("position") < 0), "short"))


def exit_reasons(rows: DataFrame) -> DataFrame:
    return rows.where("action = 'exit'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
