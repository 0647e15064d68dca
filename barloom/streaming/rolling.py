"""The features of indicators.pair_features_16 for a symbol's rows held in memory, all rows at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view

from barloom.operators.indicators import PAIR_FEATURES

EPS = 1e-10
#: Rows that a row's features look back on.
LOOKBACK = 121
CHUNK = 4096


def last(x: np.ndarray, n: int) -> np.ndarray:
    """(rows, n): each row's last n values, itself included; NaN before the first."""
    return sliding_window_view(np.concatenate([np.full(n - 1, np.nan), x]), n)


def over(a: np.ndarray, b: np.ndarray, flat: np.ndarray, value: float) -> np.ndarray:
    """a / b, or value on flat rows."""
    return np.where(flat, value, a / np.where(flat, 1.0, b))


def macd_lines(c: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9, frame: int = 120, least: int = 35, tail: int = 19) -> tuple[np.ndarray, np.ndarray]:
    """macd and its signal; a frame that reaches before the first row is filled with its close, which leaves the averages as seeded."""
    w = sliding_window_view(np.concatenate([np.full(frame - 1, c[0]), c]), frame)
    f = s = w[:, 0]
    line = []
    for k in range(frame):
        f, s = f + 2.0 / (fast + 1) * (w[:, k] - f), s + 2.0 / (slow + 1) * (w[:, k] - s)
        if k >= frame - tail:
            line.append(f - s)
    smooth = line[0]
    for x in line[1:]:
        smooth = 2.0 / (signal + 1) * x + (1 - 2.0 / (signal + 1)) * smooth
    known = np.arange(len(c)) >= least - 1
    return np.where(known, line[-1], np.nan), np.where(known, smooth, np.nan)


def _features(b: pd.DataFrame, pip: np.ndarray) -> dict[str, np.ndarray]:
    o, h, low, c, sp, tk = (b[x].to_numpy(dtype=float) for x in ("o", "h", "l", "c", "sp", "tk"))
    before = np.concatenate([[np.nan], c[:-1]])
    d, size, tp = c - before, h - low, (h + low + c) / 3
    gain, loss = last(np.fmax(d, 0), 14).mean(axis=1), last(np.fmax(-d, 0), 14).mean(axis=1)
    gain[:14] = loss[:14] = np.nan  # the first row has no change
    line, signal = macd_lines(c)
    mean, dev = last(c, 20).mean(axis=1), last(c, 20).std(axis=1, ddof=1)
    tr = np.maximum(size, np.maximum(np.abs(h - before), np.abs(low - before)))
    top, bottom = last(h, 15).max(axis=1), last(low, 15).min(axis=1)
    k = last(over(100 * (c - bottom), top - bottom, top - bottom < EPS, 50.0), 3).mean(axis=1)
    stoch_d = last(k, 3).mean(axis=1)
    k[:19] = stoch_d[:19] = np.nan
    typical = last(tp, 20)
    about = np.abs(typical - typical.mean(axis=1, keepdims=True)).mean(axis=1)
    top14, bottom14 = last(h, 14).max(axis=1), last(low, 14).min(axis=1)
    change = (c - last(c, 6)[:, 0]) / (last(d, 5).std(axis=1) + EPS)
    out = {
        "rsi": np.where(loss < EPS, 100.0, 100 - 100 / (1 + gain / np.where(loss < EPS, 1.0, loss))) + 0 * loss,
        "macd": line / pip, "macd_hist": (line - signal) / pip,
        "bb_pct_b": over(c - mean + 2 * dev, 4 * dev, dev < EPS, 0.5), "bb_bandwidth": np.where(dev < EPS, 0.0, 4 * dev / mean),
        "atr_pips": last(tr, 14).mean(axis=1) / pip, "stoch_k": k, "stoch_d": stoch_d,
        "cci": over(tp - typical.mean(axis=1), 0.015 * about, about < EPS, 0.0), "willr": over(-100 * (top14 - c), top14 - bottom14, top14 - bottom14 < EPS, -50.0),
        "log_ret": np.where(before > 0, np.log(c / before), 0.0), "tick_vel": tk, "spread_pip": sp, "range_pips": size / pip,
        "body_ratio": np.where(size > EPS, np.abs(c - o) / np.where(size > EPS, size, 1.0), 0.0), "mom5": np.where(np.isnan(change), 0.0, change),
    }
    for x in out.values():
        x[:1] = np.nan
    return out


def pair_features(bars: pd.DataFrame, first: int, pip: np.ndarray) -> pd.DataFrame:
    """PAIR_FEATURES of the rows from number `first` on, NaN where not defined; pip has a value for each of these rows."""
    parts = []
    for a in range(first, len(bars), CHUNK):
        z, start = min(a + CHUNK, len(bars)), max(0, a - LOOKBACK)
        scale = np.concatenate([np.ones(a - start), pip[a - first : z - first]])
        with np.errstate(all="ignore"):
            made = _features(bars.iloc[start:z], scale)
        parts.append(pd.DataFrame({name: np.asarray(x[a - start :], dtype=float) for name, x in ((n, made[n]) for n in PAIR_FEATURES)}))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=PAIR_FEATURES)
