"""Indicators over a symbol's bars: every function adds columns to a long (symbol, dt, ...) table.

Frames are ROWS frames of one window per symbol, so all of them share a sort.
Functions marked bounded() look back on so many rows only and run over blocks
of rows (operators/carry.py); running values of a whole series are scans.
"""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import clip, liquidity_stress, log_ratio
from barloom.operators.carry import in_blocks, numbered_first, running

EPS = 1e-10


def bounded(lookback: Callable[[dict], int]) -> Callable:
    """Runs a function of a symbol's rows over blocks; lookback gives, from its arguments, how many rows before one it reads.

    inner(f) is f without the blocks, for use in another one's.
    """

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def run(b: DataFrame, *args: object, **named: object) -> DataFrame:
            given = inspect.signature(f).bind(b, *args, **named)
            given.apply_defaults()
            return in_blocks(b, lookback(given.arguments), lambda x: f(x, *args, **named))

        return run

    return wrap


def inner(f: Callable) -> Callable:
    return getattr(f, "__wrapped__", f)


def by_time() -> Window:
    """A symbol's rows in time order."""
    return Window.partitionBy("symbol").orderBy("dt")


def rows(a: int, b: int = 0) -> Window:
    return by_time().rowsBetween(a, b)


def full(n: int, x: Column) -> Column:
    """x from the n-th row on, null before."""
    return F.when(F.row_number().over(by_time()) >= n, x)


@bounded(lambda a: a["k"])
def log_ret(b: DataFrame, k: int = 1, clamp: bool = False) -> DataFrame:
    """ret_k: ln(c / c k rows back); before row k 0, or with clamp against the first row."""
    back = F.lag("c", k).over(by_time())
    if clamp:
        back = F.coalesce(back, F.first("c").over(rows(Window.unboundedPreceding)))
    return b.withColumn(f"ret_{k}", F.coalesce(log_ratio(F.col("c"), back), F.lit(0.0)))


@bounded(lambda a: 1)
def price_velocity(b: DataFrame) -> DataFrame:
    before = F.lag("c").over(by_time())
    return b.withColumn("price_velocity", F.round(F.coalesce(F.try_divide(F.col("c") - before, before + EPS), F.lit(0.0)), 8))


@bounded(lambda a: a["n"])
def spread_z_incl(b: DataFrame, column: str = "sp", n: int = 60) -> DataFrame:
    """z of the value against the last n rows, itself included, sample deviation; 0 on the first row."""
    w = rows(1 - n)
    z = (F.col(column) - F.avg(column).over(w)) / (F.coalesce(F.stddev_samp(column).over(w), F.lit(0.0)) + EPS)
    return b.withColumn(f"{column}_z", F.round(z, 4))


@bounded(lambda a: a["n"])
def z_past(b: DataFrame, column: str, n: int = 60, floor: float = EPS, in_root: bool = False) -> DataFrame:
    """z against the n rows before, population deviation; 0 on the first row. in_root: floor is added to the variance."""
    w = rows(-n, -1)
    std = F.sqrt(F.var_pop(column).over(w) + floor) if in_root else F.stddev_pop(column).over(w) + floor
    return b.withColumn(f"{column}_z{n}", F.coalesce(F.try_divide(F.col(column) - F.avg(column).over(w), std), F.lit(0.0)))


@bounded(lambda a: a["n"] + 1)
def rsi(b: DataFrame, n: int = 14) -> DataFrame:
    """Simple-mean RSI; 100 without losses, null before n + 1 rows."""
    b = b.withColumn("__d", F.col("c") - F.lag("c").over(by_time()))
    gain, loss = (F.avg(F.greatest(x, F.lit(0.0))).over(rows(1 - n)) for x in (F.col("__d"), -F.col("__d")))
    value = F.when(loss < EPS, 100.0).otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))
    return b.withColumn("rsi", full(n + 1, value)).drop("__d")


def ema_of(values: Column, n: int) -> Column:
    """EMA of an array, seeded with its first value."""
    a = 2.0 / (n + 1)
    return F.aggregate(F.slice(values, 2, F.size(values)), values[0], lambda s, x: a * x + (1 - a) * s)


def decayed(x: Column, a: float, n: int, name: str, b: DataFrame) -> DataFrame:
    """b with column name: the sum over the last n rows (fewer at a series' start) of a (1 - a)^j x, j rows back; by doubling, log2(n) lags."""
    done, span, b = 0, 1, b.withColumns({"__power": a * x, name: F.lit(0.0)})
    while done < n:  # __power sums `span` rows
        if n & span:
            b = b.withColumn(name, F.col("__power") + (1 - a) ** span * F.lag(name, span, 0.0).over(by_time()))
            done += span
        if done < n:
            b = b.withColumn("__power", F.col("__power") + (1 - a) ** span * F.lag("__power", span, 0.0).over(by_time()))
        span *= 2
    return b.drop("__power")


@bounded(lambda a: a["frame"])
def ema(b: DataFrame, n: int, frame: int) -> DataFrame:
    """EMA seeded at the head of the last `frame` rows, which bounds the recursion."""
    a = 2.0 / (n + 1)
    b = decayed(F.col("c"), a, frame, "__sum", b)
    w = rows(1 - frame)
    return b.withColumn(f"ema_{n}", F.col("__sum") + F.pow(F.lit(1 - a), F.count("*").over(w)) * F.first("c").over(w)).drop("__sum")


def ema_from(b: DataFrame, column: str, a: float, start: float, name: str) -> DataFrame:
    """EMA over a symbol's whole series from a given start: rows further back than double precision sees are left out."""
    n = 2 ** math.ceil(math.log2(math.log(1e-18) / math.log(1 - a)))
    return in_blocks(b, n, lambda x: decayed(F.col(column).cast("double"), a, n, name, x).withColumn(name, F.col(name) + start * F.pow(F.lit(1 - a), F.col("__no"))))


@bounded(lambda a: a["frame"])
def macd(b: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, frame: int = 120, least: int = 35, tail: int = 19) -> DataFrame:
    """macd and macd_signal, both EMAs seeded at the head of the frame; the signal is seeded anew on the last `tail` values."""
    def lines(values: Column) -> Column:
        """The last `tail` values of the line."""
        steps = F.aggregate(
            values,
            F.struct(values[0].alias("f"), values[0].alias("s"), F.array().cast("array<double>").alias("line")),
            lambda s, x: F.struct(
                (s["f"] + (2.0 / (fast + 1)) * (x - s["f"])).alias("f"),
                (s["s"] + (2.0 / (slow + 1)) * (x - s["s"])).alias("s"),
                F.concat(F.slice(s["line"], F.greatest(F.size(s["line"]) - (tail - 2), F.lit(1)), F.lit(tail - 1)), F.array((s["f"] + (2.0 / (fast + 1)) * (x - s["f"])) - (s["s"] + (2.0 / (slow + 1)) * (x - s["s"])))).alias("line"),
            ),
        )
        return steps["line"]

    held = b.withColumn("__w", F.collect_list("c").over(rows(1 - frame)))
    held = held.withColumn("__m", lines(F.col("__w")))
    out = held.withColumns({"macd": full(least, F.element_at("__m", -1)), "macd_signal": full(least, ema_of(F.col("__m"), signal))})
    return out.drop("__w", "__m")


@bounded(lambda a: a["n"])
def bollinger(b: DataFrame, n: int = 20) -> DataFrame:
    """pct_b and bandwidth of mean +- 2 sample deviations; (0.5, 0) when flat, null before n rows."""
    w = rows(1 - n)
    b = b.withColumns({"__m": F.avg("c").over(w), "__s": F.stddev_samp("c").over(w)})
    flat = F.col("__s") < EPS
    pct = F.when(flat, 0.5).otherwise(F.try_divide(F.col("c") - F.col("__m") + 2 * F.col("__s"), 4 * F.col("__s")))
    width = F.when(flat, 0.0).otherwise(F.try_divide(4 * F.col("__s"), F.col("__m")))
    return b.withColumns({"pct_b": full(n, pct), "bandwidth": full(n, width)}).drop("__m", "__s")


def true_range(b: DataFrame, own_close: bool = False) -> DataFrame:
    """tr: against the close before; on the first row against its own close, or null."""
    before = F.lag("c").over(by_time())
    before = F.coalesce(before, F.col("c")) if own_close else before
    tr = F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - before), F.abs(F.col("l") - before))
    return b.withColumn("tr", F.when(before.isNotNull(), tr))


@bounded(lambda a: a["n"] + 1)
def atr_14(b: DataFrame, n: int = 14) -> DataFrame:
    """Mean of the last n true ranges, null before n + 1 rows."""
    return true_range(b).withColumn("atr_14", full(n + 1, F.avg("tr").over(rows(1 - n)))).drop("tr")


@bounded(lambda a: a["n"] + 1)
def atr_series(b: DataFrame, n: int = 14) -> DataFrame:
    """Mean of up to n true ranges, null on the first two rows."""
    return true_range(b).withColumn("atr_series", full(3, F.avg("tr").over(rows(1 - n)))).drop("tr")


@bounded(lambda a: a["n"] + 1)
def atr_norm(b: DataFrame, n: int = 14) -> DataFrame:
    """Mean true range of up to n rows, the first against its own close, over the price."""
    return true_range(b, own_close=True).withColumn("atr_norm", F.try_divide(F.avg("tr").over(rows(1 - n)), F.abs("c"))).drop("tr")


@bounded(lambda a: a["n"] + 1)
def atr_proxy_24(b: DataFrame, n: int = 24) -> DataFrame:
    """Mean of up to n true ranges without the first row's; rows 1 and 2 have their own range."""
    return true_range(b).withColumn("atr_proxy", F.when(F.row_number().over(by_time()) <= 2, F.col("h") - F.col("l")).otherwise(F.avg("tr").over(rows(1 - n)))).drop("tr")


@bounded(lambda a: a["n"] + 2 * a["smooth"] + a["d"])
def stochastic(b: DataFrame, n: int = 14, smooth: int = 3, d: int = 3) -> DataFrame:
    """stoch_k, stoch_d over n + 1 rows, smoothed; 50 when flat, null before n + 2 * smooth rows."""
    hi, lo = F.max("h").over(rows(-n)), F.min("l").over(rows(-n))
    b = b.withColumn("__raw", full(n + 1, F.when(hi - lo < EPS, 50.0).otherwise(F.try_divide(100 * (F.col("c") - lo), hi - lo))))
    b = b.withColumn("__k", F.avg("__raw").over(rows(1 - smooth)))
    return b.withColumns({"stoch_k": full(n + 2 * smooth, F.col("__k")), "stoch_d": full(n + 2 * smooth, F.avg("__k").over(rows(1 - d)))}).drop("__raw", "__k")


@bounded(lambda a: a["n"])
def cci(b: DataFrame, n: int = 20) -> DataFrame:
    """(typical price - mean) / (0.015 mean deviation about that mean); 0 when flat, null before n rows."""
    b = b.withColumn("__tp", (F.col("h") + F.col("l") + F.col("c")) / 3)
    b = b.withColumns({"__w": F.collect_list("__tp").over(rows(1 - n)), "__m": F.avg("__tp").over(rows(1 - n))})
    dev = F.aggregate("__w", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("__m"))) / F.size("__w")
    return b.withColumn("__dev", dev).withColumn("cci", full(n, F.when(F.col("__dev") < EPS, 0.0).otherwise(F.try_divide(F.col("__tp") - F.col("__m"), 0.015 * F.col("__dev"))))).drop("__tp", "__w", "__m", "__dev")


@bounded(lambda a: a["n"])
def williams_r(b: DataFrame, n: int = 14) -> DataFrame:
    hi, lo = F.max("h").over(rows(1 - n)), F.min("l").over(rows(1 - n))
    return b.withColumn("will_r", full(n, F.when(hi - lo < EPS, -50.0).otherwise(F.try_divide(-100 * (hi - F.col("c")), hi - lo))))


@bounded(lambda a: a["n"] + 1)
def mom5(b: DataFrame, n: int = 5) -> DataFrame:
    """(c - c n rows back) / (population deviation of the last n differences + EPS)."""
    b = b.withColumn("__d", F.col("c") - F.lag("c").over(by_time()))
    return b.withColumn("mom5", full(n + 1, (F.col("c") - F.lag("c", n).over(by_time())) / (F.stddev_pop("__d").over(rows(1 - n)) + EPS))).drop("__d")


def shape(b: DataFrame) -> DataFrame:
    """range_norm and body_ratio of each bar."""
    size = F.col("h") - F.col("l")
    return b.withColumns({"range_norm": F.try_divide(size, F.abs("c")), "body_ratio": F.when(size < EPS, 0.0).otherwise(F.try_divide(F.abs(F.col("c") - F.col("o")), size))})


@bounded(lambda a: 120)
def pair_features_16(b: DataFrame, pip: Column) -> DataFrame:
    """The 16 features of a tradable symbol's bar, lengths in pips, in one pass; all null on a symbol's first bar."""
    for f in (rsi, macd, bollinger, atr_14, stochastic, cci, williams_r, mom5):
        b = inner(f)(b)
    before, size = F.lag("c").over(by_time()), F.col("h") - F.col("l")
    made = {
        "rsi": F.col("rsi"), "macd_hist": (F.col("macd") - F.col("macd_signal")) / pip, "macd": F.col("macd") / pip, "bb_pct_b": F.col("pct_b"), "bb_bandwidth": F.col("bandwidth"), "atr_pips": F.col("atr_14") / pip,
        "stoch_k": F.col("stoch_k"), "stoch_d": F.col("stoch_d"), "cci": F.col("cci"), "willr": F.col("will_r"), "log_ret": F.when(before > 0, log_ratio(F.col("c"), before)).otherwise(0.0), "tick_vel": F.col("tk").cast("double"), "spread_pip": F.col("sp"),
        "range_pips": size / pip, "body_ratio": F.when(size > EPS, F.abs(F.col("c") - F.col("o")) / size).otherwise(0.0), "mom5": F.coalesce("mom5", F.lit(0.0)),
    }
    b = b.withColumn("__second", before.isNotNull()).withColumns(made)
    return b.withColumns({c: F.when(F.col("__second"), F.col(c)) for c in made}).drop("__second", "macd_signal", "pct_b", "bandwidth", "atr_14", "will_r")


#: Features of pair_features_16 and signal_features_7, in order.
PAIR_FEATURES = "rsi macd macd_hist bb_pct_b bb_bandwidth atr_pips stoch_k stoch_d cci willr log_ret tick_vel spread_pip range_pips body_ratio mom5".split()
SIGNAL_FEATURES = "log_ret rsi_14 macd_hist bb_bandwidth atr_14 cci_20 laplacian_residual".split()


@bounded(lambda a: 120)
def signal_features_7(b: DataFrame, pip: Column, residual: Column) -> DataFrame:
    """The seven features of a symbol that only informs; residual is its bar's graph residual. Without it, null on a symbol's first bar."""
    for f in (rsi, macd, bollinger, atr_14, cci):
        b = inner(f)(b)
    before = F.lag("c").over(by_time())
    made = {
        "log_ret": F.when(before > EPS, log_ratio(F.col("c"), before)).otherwise(0.0), "rsi_14": F.col("rsi"), "macd_hist": (F.col("macd") - F.col("macd_signal")) / pip,
        "bb_bandwidth": F.col("bandwidth"), "atr_14": F.col("atr_14") / pip, "cci_20": F.col("cci"),
    }
    b = b.withColumn("__second", before.isNotNull()).withColumns(made)
    return b.withColumns({c: F.when(F.col("__second"), F.col(c)) for c in made} | {"laplacian_residual": residual}).drop("__second", "macd", "macd_signal", "rsi", "pct_b", "bandwidth", "cci")


@bounded(lambda a: 62)
def microstructure_4(b: DataFrame) -> DataFrame:
    """Tick and spread z, order-flow proxy tk * sign(ret_1) and price velocity."""
    b = inner(z_past)(inner(z_past)(inner(log_ret)(inner(price_velocity)(b)), "tk"), "sp")
    return b.withColumn("ofi", F.col("tk") * F.signum("ret_1"))


@bounded(lambda a: a["n"] + 1)
def rolling_vol_24(b: DataFrame, n: int = 24) -> DataFrame:
    return inner(log_ret)(b).withColumn("vol_24", F.stddev_pop("ret_1").over(rows(1 - n)))


@bounded(lambda a: 16)
def regime_signal(b: DataFrame) -> DataFrame:
    """ret_3 / atr_norm, clipped to 5 either way."""
    b = inner(atr_norm)(inner(log_ret)(b, 3))
    return b.withColumn("regime_signal", clip(F.coalesce(F.try_divide(F.col("ret_3"), F.abs("atr_norm")), F.lit(0.0)), -5, 5))


@bounded(lambda a: a["n"] + 1)
def trend_regime(b: DataFrame, n: int = 12) -> DataFrame:
    """n-row trend over mean absolute return times sqrt(n), clipped to 3, divided by 3; 0 under 3 rows."""
    b = inner(log_ret)(b)
    mean = F.avg(F.abs("ret_1")).over(rows(1 - n))
    trend = F.sum("ret_1").over(rows(1 - n))
    return b.withColumn("trend_regime", F.when(F.count("*").over(rows(1 - n)) < 3, 0.0).otherwise(clip(F.coalesce(F.try_divide(trend, mean * n**0.5), F.lit(0.0)), -3, 3) / 3))


@bounded(lambda a: 1)
def changes(b: DataFrame, column: str, name: str) -> DataFrame:
    """Whether a column differs from the row before; false on the first row."""
    return b.withColumn(name, F.coalesce(F.col(column) != F.lag(column).over(by_time()), F.lit(False)))


@numbered_first
def islands(b: DataFrame, column: str, name: str = "island") -> DataFrame:
    """Number of the run of equal values that a row lies in, by symbol: a running sum of changes."""
    return running(changes(b, column, "__change"), sums={name: F.col("__change").cast("int")}).drop("__change")


@numbered_first
def run_length(b: DataFrame, column: str, name: str) -> DataFrame:
    """How many rows of its run of equal values a row ends: its number less that of the last change."""
    b = running(changes(b, column, "__change"), sums={"__at": F.lit(1)}, lasts={"__since": F.when(F.col("__change") | (F.col("__no") == 1), F.col("__no"))})
    return b.withColumn(name, F.col("__at") - F.col("__since") + 1).drop("__change", "__at", "__since")


#: Sessions in which trades are opened.
TRADE_SESSIONS = (2, 3, 4)


@numbered_first
def session_progress(b: DataFrame, session: str) -> DataFrame:
    """progress: how many bars of its run a bar of a trade session ends, 0 in other sessions."""
    b = run_length(b, session, "__run")
    return b.withColumn("progress", F.when(F.col(session).isin(*TRADE_SESSIONS), F.col("__run")).otherwise(0)).drop("__run")


def opening_range(b: DataFrame, session: str, k: int = 3, safe: bool = True) -> DataFrame:
    """or_ready, or_width and or_breakout of a trade session run's first k real bars; zeros elsewhere and in runs without k of them.

    ready is from the run's k-th bar on; the width is over the close, the
    signed breakout the close's distance from the range's middle in widths.
    The unsafe form gives them to all bars of the run, those before the range
    is known included; the safe one from the k-th real bar on. or_high and
    or_low are null where the width is 0 for want of a range.
    """
    b = islands(session_progress(b, session), session)
    run = Window.partitionBy("symbol", "island")
    b = b.withColumn("__n", F.sum(F.col("real").cast("int")).over(run.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)))
    first = (F.col("__n") <= k) & F.col("real")
    b = b.withColumns({"or_high": F.max(F.when(first, F.col("h"))).over(run), "or_low": F.min(F.when(first, F.col("l"))).over(run), "__top": F.max(F.when(first, F.col("c"))).over(run), "__all": F.max("__n").over(run)})
    known = F.col(session).isin(*TRADE_SESSIONS) & (F.col("__all") >= k) & ((F.col("__n") >= k) if safe else F.lit(True))
    width = F.greatest(F.col("or_high") - F.col("or_low"), F.greatest("__top", F.lit(1e-6)) * 1e-6)
    b = b.withColumns(
        {
            "or_ready": F.col("progress") >= k, "or_width": F.when(known, width / F.greatest("c", F.lit(1e-6))).otherwise(0.0),
            "or_breakout": F.when(known, (F.col("c") - (F.col("or_high") + F.col("or_low")) / 2) / width).otherwise(0.0),
        }
    )
    return b.withColumns({c: F.when(known, F.col(c)) for c in ("or_high", "or_low")}).drop("__n", "__top", "__all", "island", "progress")


def residual_streak(b: DataFrame, column: str, dead: float) -> DataFrame:
    """Length of the run of one sign, values within the dead zone being 0 (streak 0); bonus log2 of it from 3 on."""
    b = b.withColumn("__sign", F.when(F.abs(column) <= dead, 0).otherwise(F.signum(column).cast("int")))
    b = run_length(b, "__sign", "__run")
    streak = F.when(F.col("__sign") == 0, 0).otherwise(F.col("__run"))
    return b.withColumn("streak", streak).withColumn("streak_bonus", F.when(F.col("streak") >= 3, F.log2("streak")).otherwise(0.0)).drop("__sign", "__run")


@numbered_first
def regime_memory(b: DataFrame, column: str, phase: str, alpha: float = 0.1, start: float = 2.0) -> DataFrame:
    """regime_before, regime_age (log1p of bars since the change), regime_ema (from `start`), session_transition (phase differs from the bar before's).

    Before the first bar the regime is `start`, and a bar of that regime ages;
    a first bar opens a session.
    """
    b = run_length(b, column, "__run")
    b = in_blocks(b, 1, lambda x: x.withColumns({"regime_before": F.coalesce(F.lag(F.col(column).cast("double")).over(by_time()), F.lit(start)), "__phase": F.lag(phase).over(by_time()), "__first": F.when(F.col("__no") == F.col("__run"), F.col(column))}))
    ongoing = F.coalesce(F.col("__first") == start, F.lit(False)).cast("int")  # the first run goes on from before the series
    b = b.withColumns({"regime_age": F.log1p(F.col("__run") - 1 + ongoing), "session_transition": F.coalesce(F.col(phase) != F.col("__phase"), F.lit(True))})
    return ema_from(b, column, alpha, start, "regime_ema").drop("__run", "__phase", "__first")


def _below(values: np.ndarray, n: int) -> np.ndarray:
    """Of each value how many of the last n, itself included, are below it.

    A wavelet matrix over the values' ranks: each bit plane keeps, in the order
    of the higher bits, prefix counts of its zeros; a count below a rank in a
    range of rows then takes a step a plane, for all rows at once.
    """
    ranks = np.unique(values, return_inverse=True)[1]
    end = np.arange(1, len(values) + 1)
    begin = np.maximum(end - n, 0)
    out, order = np.zeros(len(values), np.int64), ranks
    for bit in reversed(range(max(1, int(ranks.max(initial=0)).bit_length()))):
        zero = (order >> bit) & 1 == 0
        zeros = np.concatenate([[0], np.cumsum(zero)])
        one = (ranks >> bit) & 1 == 1
        out += np.where(one, zeros[end] - zeros[begin], 0)  # those with a 0 here are below, among rows alike so far
        begin, end = (np.where(one, zeros[-1] + x - zeros[x], zeros[x]) for x in (begin, end))
        order = np.concatenate([order[zero], order[~zero]])
    return out


def vol_percentile(b: DataFrame, column: str, n: int) -> DataFrame:
    """vol_pct: share of a symbol's last n positive values, the bar's own included, that are below its value; .5 until two are known.

    Bars whose value is not positive are judged but not counted. A block of
    rows with the n before it is ranked at once, in log2(n) steps a row.
    """
    b = running(b, sums={"__seen": (F.coalesce(F.col(column), F.lit(0.0)) > 0).cast("int")})
    counted = b.where(F.col(column) > 0)  # numbered among themselves
    if "__no" in b.columns:
        raise ValueError("rows must not be numbered yet")

    def ranked(x: DataFrame) -> DataFrame:
        def of(key: tuple, t: pa.Table) -> pa.Table:
            t = t.sort_by("__no")
            v = t.column(column).to_numpy().astype(np.float64)
            share = _below(v, n) / np.minimum(np.arange(1, len(v) + 1), n)
            return t.append_column("vol_pct", pa.array(share, pa.float64()))

        schema = x.withColumn("vol_pct", F.lit(0.0)).schema
        return x.groupBy("symbol").applyInArrow(of, schema)

    placed = in_blocks(counted, n, ranked)
    shares = placed.withColumn("vol_pct", F.when(F.col("__seen") <= 1, 0.5).otherwise(F.col("vol_pct")))
    others = b.where(~F.coalesce(F.col(column) > 0, F.lit(False))).withColumn("vol_pct", F.when(F.col("__seen") <= 1, 0.5).otherwise(0.0))
    return shares.unionByName(others).drop("__seen")


@bounded(lambda a: a["k"])
def horizon_return(b: DataFrame, k: int) -> DataFrame:
    """ret_hk: ln of the close over that k rows back, or the first row's; 0 on the first row."""
    return inner(log_ret)(b, k, clamp=True).withColumnRenamed(f"ret_{k}", f"ret_h{k}")


@bounded(lambda a: a["n"])
def gap_delta(b: DataFrame, column: str, n: int = 60) -> DataFrame:
    """gap_delta: a column less its value n - 1 rows back, 0 before n rows."""
    return b.withColumn("gap_delta", F.coalesce(F.col(column) - F.lag(column, n - 1).over(by_time()), F.lit(0.0)))


#: The code before any weekend was seen.
NORMAL = 1


@numbered_first
def weekend_carry(b: DataFrame, regime: str, step_minutes: int = 5) -> DataFrame:
    """weekend_regime, the code of `regime` (0 to 4) at the last Sunday's end, and weekend_shift from the Saturday's start before it.

    The start is the first step_minutes of Saturday (its last bar counts), the
    end the last ones of Sunday (its first bar counts). Both are normal before
    they were seen; the shift is 0 until the first Sunday's end.
    """
    minute = F.hour("dt") * 60 + F.minute("dt")
    opens = F.when((F.weekday("dt") == 5) & (minute < step_minutes), F.col(regime))
    b = running(b, lasts={"__open": opens})
    close = F.when((F.weekday("dt") == 6) & (minute >= 1440 - step_minutes), F.struct(F.to_date("dt").alias("day"), F.col(regime).alias("regime"), F.coalesce("__open", F.lit(NORMAL)).alias("open")))
    b = running(b.withColumn("__close", close), lasts={"__seen": F.col("__close")})
    b = in_blocks(b, 1, lambda x: x.withColumn("__before", F.lag("__seen").over(by_time())))
    first = F.when(F.col("__close").isNotNull() & ~F.coalesce(F.col("__close.day") == F.col("__before.day"), F.lit(False)), F.col("__close"))
    b = running(b, lasts={"__end": first})
    return b.withColumns({"weekend_regime": F.coalesce("__end.regime", F.lit(NORMAL)), "weekend_shift": F.coalesce(F.col("__end.regime") - F.col("__end.open"), F.lit(0))}).drop("__open", "__close", "__seen", "__before", "__end")


@bounded(lambda a: a["n"] + 16)
def atr_ratio(b: DataFrame, n: int = 60) -> DataFrame:
    b = inner(atr_14)(b)
    return b.withColumn("atr_ratio", F.try_divide(F.col("atr_14"), F.avg("atr_14").over(rows(1 - n))))


@numbered_first
def cooldown_mask(b: DataFrame, stop: str, n: int) -> DataFrame:
    """For n rows after a stop event: locked, and rows left."""
    b = running(b, sums={"__at": F.lit(1)}, lasts={"__stop": F.when(F.col(stop), F.col("__no"))})
    b = in_blocks(b, 1, lambda x: x.withColumn("__since", F.col("__at") - F.lag("__stop").over(by_time())))
    b = b.withColumn("cooldown_left", F.coalesce(F.greatest(n - F.col("__since") + 1, F.lit(0)), F.lit(0)))
    return b.withColumn("locked", F.col("cooldown_left") > 0).drop("__at", "__stop", "__since")


@bounded(lambda a: a["n"])
def sequence_window(b: DataFrame, column: str, n: int) -> DataFrame:
    """The last n values as an array, padded with 0 at the left."""
    held = F.collect_list(column).over(rows(1 - n))
    return b.withColumn("seq", F.concat(F.array_repeat(F.lit(0.0), n - F.size(held)), held))


@bounded(lambda a: 66)
def session_local_features(b: DataFrame) -> DataFrame:
    """Per-bar local features: returns of 1, 3 and 6 rows, range proxy, shape, past z of spread and ticks, stress."""
    for k in (1, 3, 6):
        b = inner(log_ret)(b, k, clamp=True)
    b = inner(z_past)(inner(z_past)(shape(inner(atr_proxy_24)(b)), "sp", 64, 1e-8, True), "tk", 64, 1e-8, True)
    return b.withColumn("stress", liquidity_stress(F.col("sp"), F.col("c"), F.col("tk")))


def scalp_context(b: DataFrame, session: str = "session_code", k: int = 3, least: float = 1e-6) -> DataFrame:
    """b with 17 features of a bar's session and the last moves; rows are real bars, regime_signal is taken as it is.

    The opening range is that of the session run's first k bars so far;
    momentum is ln of the close over that 3, 6 and 12 bars back (0 without
    them), volatility the root mean square of 6 and 12 returns (0 below three
    bars), tick_shock the ticks' z against the 12 bars before (0 below four bars).
    """
    b = islands(b, session)
    run = Window.partitionBy("symbol", "island").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("__c", F.greatest(F.col("c"), F.lit(least)))
    back = lambda n: F.coalesce(log_ratio(F.col("__c"), F.lag("__c", n).over(by_time())), F.lit(0.0))
    b = b.withColumns({"__seen": F.count("*").over(run), "__rn": F.row_number().over(by_time()), "__r": F.when(F.lag("__c").over(by_time()).isNotNull(), back(1)), "trade_session": F.col(session).isin(*TRADE_SESSIONS).cast("double"), **{f"momentum_{n}": back(n) for n in (3, 6, 12)}})
    first = F.col("__seen") <= k
    b = b.withColumns({"__hi": F.max(F.when(first, F.col("h"))).over(run), "__lo": F.min(F.when(first, F.col("l"))).over(run)})
    b = b.withColumns({f"volatility_{n}": F.when(F.col("__rn") < 3, 0.0).otherwise(F.sqrt(F.avg(F.col("__r") * F.col("__r")).over(rows(1 - n)))) for n in (6, 12)})
    width = F.greatest(F.col("__hi") - F.col("__lo"), F.col("__c") * least)
    per_vol = lambda x: F.when(F.col("volatility_12") > 0, x / F.greatest("volatility_12", F.lit(least))).otherwise(0.0)
    moves = [F.col(f"momentum_{n}") for n in (3, 6, 12)]
    moved = sum((F.when(F.abs(m) > least, 1).otherwise(0) for m in moves), F.lit(0))
    signs = sum((F.when(F.abs(m) > least, F.signum(m)).otherwise(0.0) for m in moves), F.lit(0.0))
    before = rows(-12, -1)
    dev = F.stddev_pop("tk").over(before)
    trade = F.col("trade_session") > 0
    b = b.withColumns(
        {
            "open_ready": F.when(trade & (F.col("__seen") >= k), 1.0).otherwise(0.0), "open_progress": F.when(trade, F.least(F.col("__seen") / float(k), F.lit(2.0))).otherwise(0.0),
            "opening_range_width": width / F.col("__c"), "range_position": clip((F.col("__c") - F.col("__lo")) / width, -3.0, 3.0), "breakout_signed": clip((F.col("__c") - (F.col("__hi") + F.col("__lo")) / 2) / width, -4.0, 4.0),
            "momentum_score": per_vol(F.abs("momentum_3")), "momentum_alignment": F.coalesce(F.try_divide(F.abs(signs), moved), F.lit(0.0)), "volatility_ratio": per_vol(F.col("volatility_6")),
            "spread_stress": F.col("sp") / F.col("__c") / F.greatest("volatility_6", F.lit(least)), "tick_shock": F.when((F.col("__rn") < 4) | (dev < least), 0.0).otherwise(F.coalesce(F.try_divide(F.col("tk") - F.avg("tk").over(before), dev), F.lit(0.0))),
        }
    )
    return b.drop("__seen", "__rn", "__c", "__r", "__hi", "__lo", "island")


def drawdown(b: DataFrame, equity: str) -> DataFrame:
    """Running peak and drawdown of an equity column."""
    return running(b, tops={"peak": F.col(equity)}).withColumn("drawdown", F.try_divide(F.col("peak") - F.col(equity), F.col("peak")))


def rebalanced(weights: DataFrame, every: int) -> DataFrame:
    """(symbol, dt, w, ret) whose w is taken at every `every`-th bar and held until the next; bars are the distinct times."""
    bars = weights.select("dt").distinct().withColumn("__i", F.row_number().over(Window.orderBy("dt")) - 1)  # one row a bar
    w = weights.join(bars, "dt")
    return running(w, lasts={"__held": F.when(F.col("__i") % every == 0, F.col("w"))}).withColumn("w", F.coalesce("__held", F.lit(0.0))).drop("__i", "__held")


def equity_curve(weights: DataFrame, cost: float, capital: float = 1.0, every: int = 1) -> DataFrame:
    """(dt, ret, turnover, equity) from (symbol, dt, w, ret): w, taken at every `every`-th bar, is held over ret; changes cost.

    The running product is over one row a time, not a symbol.
    """
    if every > 1:
        weights = rebalanced(weights, every)
    per = in_blocks(weights, 1, lambda x: x.withColumn("turn", F.abs(F.col("w") - F.coalesce(F.lag("w").over(by_time()), F.lit(0.0)))))
    step = per.groupBy("dt").agg(F.sum(F.col("w") * F.col("ret")).alias("gross"), F.sum("turn").alias("turnover")).withColumn("ret", F.col("gross") - F.col("turnover") * cost)
    return step.withColumn("equity", capital * F.exp(F.sum(F.log1p("ret")).over(Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)))).drop("gross")
