"""The trading simulation: a position state machine over pairs, with everything rolling computed before it.

Rows of (config_id, trading_year, pair order, date) carry log prices, rolling mean, deviation and z; the state machine
itself runs in Python by group. Where no cap on positions binds and capital does not compound, pairs do not touch each
other and a group is a pair; otherwise a group is a configuration and year.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import frame


@dataclass(frozen=True)
class Rules:
    """Parameters of the simulation; sigma thresholds are in deviations of the spread."""

    entry_sigma: float = 2.0
    exit_sigma: float = 0.5
    stop_sigma: float = 4.0
    exit_tolerance: float = 0.1
    lookback: int = 60
    max_holding_days: int = 60
    holding_multiple: float = 0.0
    max_dynamic_days: int = 0
    time_based_stops: bool = True
    stop_tightening: float = 0.15
    adaptive_stop: bool = False
    fixed_exit: bool = True
    dynamic_exit_ratio: float = 0.0
    dynamic_exit_margin: float = 0.0
    slow_ratio: float = 0.0
    slow_share: float = 0.5
    regime_break: bool = True
    max_positions: int = 0
    compounding: bool = False
    capital: float = 50_000.0
    capital_per_pair: float = 10_000.0
    leverage: float = 1.0
    max_capital_per_trade: float = 0.0
    cost_bps: float = 10.0

    @property
    def independent(self) -> bool:
        return self.max_positions == 0 and not self.compounding


def stop_level(rules: Rules, half_life: float, held: int) -> float:
    base = rules.stop_sigma
    if rules.adaptive_stop:
        base = min(max(base + 0.5 * (half_life / 10 - 1), 3.0), 5.0)
    return base


def exit_reason(rules: Rules, side: int, z: float, entry: dict, spread: float, held: int, half_life: float) -> str | None:
    """Why an open position closes on this bar, or None. The rules are tried in order; a sign change of the spread
    against the entry's overrides the earlier ones."""
    limit = rules.max_holding_days
    if rules.holding_multiple > 0:
        limit = math.ceil(rules.holding_multiple * half_life)
        limit = max(1, min(limit, rules.max_dynamic_days) if rules.max_dynamic_days > 0 else limit)
    reason = "max_holding" if held >= limit else None
    if not reason and rules.dynamic_exit_ratio and held >= rules.dynamic_exit_ratio * half_life and abs(z) >= abs(entry["z"]) + rules.dynamic_exit_margin:
        reason = "z_diverging"
    if not reason and rules.slow_ratio and held >= rules.slow_ratio * half_life and entry["z"] and abs(z) / abs(entry["z"]) > rules.slow_share:
        reason = "slow_convergence"
    if rules.regime_break and entry["spread"] * spread < 0:
        reason = "regime_break"
    if reason:
        return reason
    band = rules.exit_sigma + rules.exit_tolerance
    if (side > 0 and z >= -band) or (side < 0 and z <= band):
        return "convergence"
    stop = stop_level(rules, half_life, held)
    if rules.time_based_stops:
        if held >= half_life:
            stop = max(stop * (1 - rules.stop_tightening * (held / half_life - 1)), 1.5)
            if (entry["z"] < 0 and z <= -stop) or (entry["z"] >= 0 and z >= stop):
                return "stop_loss_time"
        return None
    return "stop_loss" if (side > 0 and z <= -stop) or (side < 0 and z >= stop) else None


TRADES = "leg_x string, leg_y string, direction string, entry_date date, exit_date date, holding_days int, entry_z double, exit_z double, hedge_ratio double, half_life double, pnl double, exit_reason string, capital_at_entry double, qty_x double, qty_y double, entry_px double, entry_py double"


def simulate_group(pdf: pd.DataFrame, rules: Rules) -> list[dict]:
    """Trades of one group. pdf: rank, leg_x, leg_y, date, x, y, hedge, half_life, spread, mu, sigma, z; all pairs on all dates."""
    pairs = {k: g.sort_values("date").reset_index(drop=True) for k, g in pdf.groupby("rank", sort=True)}
    n = min(len(g) for g in pairs.values())
    rows = {k: g.to_dict("list") for k, g in pairs.items()}
    warmup, capital = max(30, rules.lookback), rules.capital
    cap = rules.max_positions or len(pairs)
    open_: dict[int, dict] = {}
    out: list[dict] = []

    def close(k: int, t: int, held: int, z: float, reason: str) -> None:
        nonlocal capital
        e, r = open_.pop(k), rows[k]
        px, py = r["x"][t], r["y"][t]
        notional = lambda a, b: abs(e["qx"] * a) + abs(e["qy"] * b)
        pnl = e["qx"] * (px - e["px"]) + e["qy"] * (py - e["py"]) - (notional(e["px"], e["py"]) + notional(px, py)) * rules.cost_bps / 1e4
        capital += pnl if rules.compounding else 0.0
        out.append({"leg_x": r["leg_x"][t], "leg_y": r["leg_y"][t], "direction": "LONG" if e["side"] > 0 else "SHORT", "entry_date": r["date"][e["t"]], "exit_date": r["date"][t], "holding_days": held, "entry_z": e["z"], "exit_z": z, "hedge_ratio": e["hedge"], "half_life": r["half_life"][t], "pnl": pnl, "exit_reason": reason, "capital_at_entry": e["capital"], "qty_x": e["qx"], "qty_y": e["qy"], "entry_px": e["px"], "entry_py": e["py"]})

    missing = lambda v: v is None or v != v
    for t in range(warmup + 1, n):
        for k in [k for k in rows if k in open_]:
            e, r = open_[k], rows[k]
            spread = math.log(r["x"][t - 1]) - e["hedge"] * math.log(r["y"][t - 1]) if rules.fixed_exit else r["spread"][t - 1]
            z = (spread - e["mu"]) / e["sigma"] if rules.fixed_exit and e["sigma"] else r["z"][t - 1]
            if missing(z):
                continue
            reason = exit_reason(rules, e["side"], z, e, spread, t - e["t"], r["half_life"][t])
            if reason:
                close(k, t, t - e["t"], z, reason)
        for k, r in rows.items():
            if len(open_) >= cap:
                break
            z = r["z"][t - 1]
            if k in open_ or missing(z) or abs(z) < rules.entry_sigma:
                continue
            side = 1 if z < 0 else -1
            own = rules.capital_per_pair * rules.leverage
            if rules.compounding:
                own = capital * rules.leverage / max(1, rules.max_positions or max(5, len(rows)))
                own = min(own, rules.max_capital_per_trade) if rules.max_capital_per_trade > 0 else own
            h = r["hedge"][t]
            nx = own / (1 + abs(h))
            open_[k] = {"t": t, "side": side, "z": z, "spread": r["spread"][t - 1], "mu": r["mu"][t - 1], "sigma": r["sigma"][t - 1], "hedge": h, "capital": own, "px": r["x"][t], "py": r["y"][t], "qx": side * nx / r["x"][t], "qy": -side * abs(h) * nx / r["y"][t]}
    for k in list(open_):
        z = rows[k]["z"][n - 1]
        close(k, n - 1, max(1, n - 1 - open_[k]["t"]), float("nan") if missing(z) else z, "period_end")
    return out


def prepare(aligned: DataFrame, chosen: DataFrame, rules: Rules, by: tuple[str, ...]) -> DataFrame:
    """Spread and rolling statistics of the chosen pairs. aligned: by..., leg_x, leg_y, date, x, y; chosen: by..., legs,
    rank, hedge, half_life. Pairs with a price that is not positive have no spread."""
    keys = [*by, "leg_x", "leg_y"]
    rows = aligned.join(chosen.select(*keys, "rank", "hedge", "half_life"), keys)
    rows = rows.withColumn("spread", F.when((F.col("x") > 0) & (F.col("y") > 0), F.log("x") - F.col("hedge") * F.log("y")))
    w = frame(rules.lookback, tuple(keys))
    enough = F.count("spread").over(w) >= 30
    rows = rows.withColumn("mu", F.when(enough, F.avg("spread").over(w))).withColumn("sigma", F.when(enough, F.stddev_samp("spread").over(w)))
    return rows.withColumn("z", F.when(F.col("sigma") > 0, (F.col("spread") - F.col("mu")) / F.col("sigma")))


def simulate(prepared: DataFrame, rules: Rules, by: tuple[str, ...]) -> DataFrame:
    """Trades with the columns of `by` and trade_seq, their order within a group."""
    keys = [*by, "leg_x", "leg_y"] if rules.independent else list(by)
    types = {f.name: f.dataType.simpleString() for f in prepared.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in by) + ", trade_seq long, " + TRADES

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        trades = pd.DataFrame(simulate_group(pdf, rules))
        if not len(trades):
            return pd.DataFrame()
        trades.insert(0, "trade_seq", range(len(trades)))
        for c in reversed(by):
            trades.insert(0, c, pdf[c].iloc[0])
        return trades

    return prepared.groupBy(*keys).applyInPandas(run, schema)
