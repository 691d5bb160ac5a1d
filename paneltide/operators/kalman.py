"""Recursive filters of hedge ratios and mean reversion. A filter's state passes from row to row, so it runs in numpy,
one series at a time (applyInPandas by pair); a series is the days of one pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .windows import BY


def ols(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Intercept, slope and residual variance of x on y."""
    slope = ((x - x.mean()) * (y - y.mean())).sum() / ((y - y.mean()) ** 2).sum()
    intercept = x.mean() - slope * y.mean()
    return intercept, slope, float(np.var(x - intercept - slope * y))


def hedge_filter(x: np.ndarray, y: np.ndarray, delta: float = 1e-4, noise: float | None = None, deltas: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """x on y with a wandering intercept and slope: hedge, intercept, spread (the innovation) and its variance.

    Starts from OLS of the first min(20, n // 4) rows; `deltas` gives each row its own speed."""
    n = len(x)
    head = max(2, min(20, n // 4))
    intercept, slope, _ = ols(x[:head], y[:head])
    noise = ols(x, y)[2] if noise is None else noise
    state, p = np.array([intercept, slope]), np.eye(2)
    out = {k: np.empty(n) for k in ("hedge", "intercept", "spread", "variance")}
    for t in range(n):
        d = delta if deltas is None else deltas[t]
        p = p + np.eye(2) * d / (1 - d)
        h = np.array([1.0, y[t]])
        error, variance = x[t] - h @ state, h @ p @ h + noise
        gain = p @ h / variance
        state, p = state + gain * error, p - np.outer(gain, h) @ p
        out["hedge"][t], out["intercept"][t], out["spread"][t], out["variance"][t] = state[1], state[0], error, variance
    return out


def engine_filter(x: np.ndarray, y: np.ndarray, delta: float = 1e-5, noise: float = 1e-3, momentum: bool = False) -> dict[str, np.ndarray]:
    """y on x, started from OLS over all rows, with the measurement noise adapted: hedge, intercept, spread (the residual
    after the update), velocity. With momentum the slope has a velocity of its own."""
    n, k = len(x), 3 if momentum else 2
    intercept, slope, variance = ols(y, x)
    state = np.zeros(k)
    state[:2] = intercept, slope
    p = np.diag([variance, variance / max(np.var(x), 1e-12), delta][:k])
    q = np.diag([delta, delta, 0.1 * delta][:k])
    step = np.eye(k)
    if momentum:
        step[1, 2] = 1.0
    out = {c: np.empty(n) for c in ("hedge", "intercept", "spread", "velocity")}
    for t in range(n):
        state, p = step @ state, step @ p @ step.T + q
        h = np.array([1.0, x[t], 0.0][:k])
        error = y[t] - h @ state
        noise = max(0.99 * noise + 0.01 * error**2, 1e-8)
        gain = p @ h / (h @ p @ h + noise)
        state = state + gain * error
        keep = np.eye(k) - np.outer(gain, h)
        p = keep @ p @ keep.T + noise * np.outer(gain, gain)
        out["hedge"][t], out["intercept"][t], out["spread"][t] = state[1], state[0], y[t] - h @ state
        out["velocity"][t] = state[2] if momentum else 0.0
    return out


def ou_filter(s: np.ndarray, q: float = 1e-5, r: float = 1e-3, theta: float = 0.1, mu: float | None = None, dt: float = 1.0) -> dict[str, np.ndarray]:
    """An extended filter of the level and speed of mean reversion: mu, theta and the prediction error."""
    n = len(s)
    state, p = np.array([s[: min(20, n)].mean() if mu is None else mu, theta]), np.eye(2) * 0.1
    out = {c: np.full(n, np.nan) for c in ("mu", "theta", "error")}
    out["mu"][0], out["theta"][0] = state
    for t in range(1, n):
        p = p + q * np.eye(2)
        error = s[t] - (s[t - 1] + state[1] * (state[0] - s[t - 1]) * dt)
        h = np.array([state[1] * dt, (state[0] - s[t - 1]) * dt])
        gain = p @ h / (h @ p @ h + r)
        state, p = state + gain * error, (np.eye(2) - np.outer(gain, h)) @ p
        state[1] = max(state[1], 1e-6)
        out["mu"][t], out["theta"][t], out["error"][t] = state[0], state[1], error
    return out


def _by_pair(rows: DataFrame, columns: list[str], run, least: int, by: tuple[str, ...] = BY) -> DataFrame:
    fields = ", ".join([f"{c} string" for c in by] + ["date date"] + [f"{c} double" for c in columns])

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        if len(pdf) < least:
            return pd.DataFrame()
        found = run(pdf)
        return pd.DataFrame({**{c: pdf[c].to_numpy() for c in by}, "date": pdf.date.to_numpy(), **{c: found[c] for c in columns}})

    return rows.groupBy(*by).applyInPandas(apply, fields)


def kalman_hedge(aligned: DataFrame, delta: float = 1e-4, noise: float | None = None, log: bool = True) -> DataFrame:
    v = np.log if log else np.asarray
    return _by_pair(aligned, ["hedge", "intercept", "spread", "variance"], lambda p: hedge_filter(v(p.x.to_numpy()), v(p.y.to_numpy()), delta, noise), 30)


def kalman_regime_hedge(aligned: DataFrame, deltas: tuple[float, float] = (1e-5, 1e-3), log: bool = True) -> DataFrame:
    """As kalman_hedge, at the speed of each row's regime. aligned has a column regime of 0 and 1."""
    v = np.log if log else np.asarray
    return _by_pair(aligned, ["hedge", "intercept", "spread", "variance"], lambda p: hedge_filter(v(p.x.to_numpy()), v(p.y.to_numpy()), deltas=np.where(p.regime.to_numpy() == 1, deltas[1], deltas[0])), 60)


def kalman_engine(aligned: DataFrame, delta: float = 1e-5, noise: float = 1e-3, momentum: bool = True, log: bool = True) -> DataFrame:
    v = np.log if log else np.asarray
    return _by_pair(aligned, ["hedge", "intercept", "spread", "velocity"], lambda p: engine_filter(v(p.x.to_numpy()), v(p.y.to_numpy()), delta, noise, momentum), 30)


def kalman_ou(series: DataFrame, by: tuple[str, ...] = BY, **how) -> DataFrame:
    return _by_pair(series.where("spread IS NOT NULL"), ["mu", "theta", "error"], lambda p: ou_filter(p.spread.to_numpy(), **how), 30, by)
