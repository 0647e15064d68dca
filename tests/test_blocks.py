"""Windows and scans over blocks of rows against the same over whole series: one symbol, many blocks."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import carry, signals
from barloom.operators import indicators as ind


@pytest.fixture(scope="module")
def series():
    rng, c, rows = random.Random(9), 100.0, []
    for i in range(900):
        c *= math.exp(rng.gauss(0, 0.01))
        rows.append(("A" if i % 9 else "B", datetime(2024, 1, 1) + timedelta(hours=i), c, c * 1.01, c * 0.99, c * (1 + rng.gauss(0, 0.002)), 0.01 * rng.random(), rng.randint(1, 9)))
    return rows


@pytest.fixture(scope="module")
def bars(spark, series):
    return spark.createDataFrame(series, "symbol string, dt timestamp_ntz, o double, h double, l double, c double, sp double, tk bigint").repartition(5)


def rows_of(df, *columns):
    """Doubles to ten digits: running sums of a block add up in another order."""
    near = lambda x: float(f"{x:.10g}") if isinstance(x, float) else x
    return sorted(tuple(map(near, r)) for r in df.select("symbol", "dt", *(F.coalesce(F.col(c).cast("double"), F.lit(-9.0)) for c in columns)).collect())


@pytest.mark.parametrize(
    ("f", "columns"),
    [
        (ind.rsi, ["rsi"]), (ind.atr_14, ["atr_14"]), (ind.atr_norm, ["atr_norm"]), (ind.bollinger, ["pct_b", "bandwidth"]), (ind.stochastic, ["stoch_k", "stoch_d"]), (ind.cci, ["cci"]), (lambda b: ind.z_past(b, "c", 60), ["c_z60"]),
        (ind.macd, ["macd", "macd_signal"]), (lambda b: ind.ema(b, 12, 50), ["ema_12"]), (lambda b: ind.log_ret(b, 6, clamp=True), ["ret_6"]), (ind.trend_regime, ["trend_regime"]), (ind.microstructure_4, ["tk_z60", "sp_z60", "ofi", "price_velocity"]),
        (lambda b: ind.pair_features_16(b, F.lit(0.01)), ind.PAIR_FEATURES),
    ],
)
def test_blocks_give_what_whole_series_give(bars, monkeypatch, f, columns):
    whole = rows_of(f(bars), *columns)
    monkeypatch.setattr(ind, "in_blocks", lambda b, n, g: carry.in_blocks(b, n, g, size=max(n, 128)))
    assert rows_of(f(bars), *columns) == whole


def test_no_task_holds_a_symbol(bars):
    """Groups of a block: its rows and the halo, whatever the symbol's length."""
    sizes = carry.in_blocks(bars, 10, lambda b: b.withColumn("n", F.count("*").over(ind.Window.partitionBy("symbol"))), size=64)
    assert sizes.agg(F.max("n")).first()[0] == 74 and sizes.count() == 900
    plan = ind.rsi(bars)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if " Window " in x and "avg(" in x]
    assert windows and all("__for" in x or "symbol#" in x for x in windows)


def test_scans(bars, series):
    b = carry.running(bars, sums={"s": F.col("tk")}, tops={"m": F.col("c")}, lasts={"k": F.when(F.col("tk") == 3, F.col("__no"))}, size=32)
    got, want, state = {(r["symbol"], r["dt"]): (r["s"], r["m"], r["k"]) for r in b.collect()}, {}, {}
    for sym, dt, _, _, _, c, _, tk in series:
        n, s, m, k = state.get(sym, (0, 0, 0.0, None))
        state[sym] = n + 1, s + tk, max(m, c), n + 1 if tk == 3 else k
        want[sym, dt] = state[sym][1:]
    assert got == want


def test_a_hold_over_many_blocks(spark):
    """One entry held for 2,500 rows over 39 blocks, and a walk after it."""
    rng, rows, want, state = np.random.default_rng(1), [], [], 0
    for i in range(3000):
        p = 0.9 if i == 10 else 0.55 if i < 2500 else float(rng.random())
        if state == 0:
            state = 1 if p >= 0.6 else -1 if 1 - p >= 0.6 else 0
        elif (p if state == 1 else 1 - p) < 0.52:
            state = 0
        rows.append(("A", datetime(2024, 1, 1) + timedelta(minutes=i), p, 1 - p))
        want.append(state)
    df = spark.createDataFrame(rows, "symbol string, dt timestamp_ntz, b double, s double")
    real = carry.composed
    signals.composed = lambda *a: real(*a, size=64)
    try:
        got = {r["dt"]: r["position"] for r in signals.hysteresis(df, "b", "s").collect()}
    finally:
        signals.composed = real
    assert [got[r[1]] for r in rows] == want and want[2499] == 1


def test_ema_from_a_start(bars, series):
    got, state = {(r["symbol"], r["dt"]): r["e"] for r in ind.ema_from(bars, "tk", 0.1, 2.0, "e").collect()}, {}
    for r in series:
        state[r[0]] = 0.1 * r[7] + 0.9 * state.get(r[0], 2.0)
        assert got[r[0], r[1]] == pytest.approx(state[r[0]], rel=1e-12)


def test_ranks_of_a_long_window():
    """A window of 43,200 over a million values, against counting for some of them."""
    x = np.random.default_rng(2).integers(0, 5000, 1_000_000).astype(float)
    got = ind._below(x, 43_200)
    for i in [0, 1, 43_199, 43_200, 500_000, 999_999]:
        w = x[max(0, i - 43_199) : i + 1]
        assert got[i] == (w < x[i]).sum()


def test_vol_percentile_over_blocks(bars, series, monkeypatch):
    monkeypatch.setattr(ind, "in_blocks", lambda b, n, g: carry.in_blocks(b, n, g, size=max(n, 60)))
    odd = F.when(F.col("tk") == 2, None).when(F.col("tk") == 3, -1.0).otherwise(F.round("c", 0))
    got, kept = {(r["symbol"], r["dt"]): r["vol_pct"] for r in ind.vol_percentile(bars.withColumn("v", odd), "v", 40).collect()}, {}
    for r in series:
        v = None if r[7] == 2 else -1.0 if r[7] == 3 else float(f"{r[5]:.0f}")
        held = kept.setdefault(r[0], [])
        if v and v > 0:
            held.append(v)
        last = held[-40:]
        want = 0.5 if len(held) <= 1 else sum(u < v for u in last) / len(last) if v and v > 0 else 0.0
        assert got[r[0], r[1]] == pytest.approx(want)


def test_weekend_and_regime_memory(spark):
    rows, codes = [], {}
    for i in range(24 * 12 * 9):
        dt = datetime(2024, 1, 5, 12) + timedelta(minutes=5 * i)
        codes[dt] = {(13, 0): 3, (14, 23): 4, (6, 0): 0}.get((dt.day, dt.hour), 1)
        rows.append(("A", dt, codes[dt], "x"))
    b = spark.createDataFrame(rows, "symbol string, dt timestamp_ntz, regime int, phase string")
    got = {r["dt"]: (r["weekend_regime"], r["weekend_shift"]) for r in ind.weekend_carry(b, "regime").collect()}
    assert got[datetime(2024, 1, 7, 23, 50)] == (1, 0) and got[datetime(2024, 1, 7, 23, 55)] == (1, 1) and got[datetime(2024, 1, 14, 11)] == (1, 1)
    mem = {r["dt"]: r for r in ind.regime_memory(b, "regime", "phase").collect()}
    first = mem[datetime(2024, 1, 5, 12)]
    assert (first["regime_before"], first["regime_age"], first["session_transition"]) == (2.0, 0.0, True) and first["regime_ema"] == pytest.approx(1.9)
    assert mem[datetime(2024, 1, 5, 12, 10)]["regime_age"] == pytest.approx(math.log(3))
