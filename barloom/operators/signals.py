"""Signals from probabilities and features: directions, gates, brackets, rankings, state machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import clip
from barloom.operators.carry import composed


def by_time() -> Window:
    """A symbol's rows in time order."""
    return Window.partitionBy("symbol").orderBy("dt")


def tradable_guard(signals: DataFrame, instrument: DataFrame) -> DataFrame:
    """Signals of symbols that are not for information only; instrument: (symbol, tradable)."""
    return signals.join(F.broadcast(instrument.where("tradable").select("symbol")), "symbol", "left_semi")


def session_pair_filter(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows whose symbol is allowed at their hour; allowed: (symbol, lo, hi) with lo <= hour < hi. An equi-join by symbol, narrowed by hour."""
    hour = F.hour("dt")
    a = allowed.select(F.col("symbol").alias("__s"), "lo", "hi")
    return rows.join(F.broadcast(a), (F.col("symbol") == F.col("__s")) & (hour >= F.col("lo")) & (hour < F.col("hi")), "left_semi")


def entry_direction(p: Column, vol: Column, base: float = 0.65, slope: float = 12.0, spread: float = 0.15, cap: float = 1.01) -> Column:
    """+1 if p reaches the threshold clip(base + slope * vol, .5, .9), -1 if 1 - p does; 0 where |2p - 1| is below spread or the larger side above cap."""
    threshold = clip(base + slope * vol, 0.5, 0.9)
    open_ = (F.greatest(p, 1 - p) <= cap) & (F.abs(2 * p - 1) >= spread)
    return F.when(open_ & (p >= threshold), 1).when(open_ & (p <= 1 - threshold), -1).otherwise(0)


def entry_gate(direction: Column, p_entry: Column, p: Column, threshold: float = 0.5) -> tuple[Column, Column]:
    """Whether the second probability backs the direction, and the trade's confidence.

    Each probability counts for the direction's side, p for a buy and 1 - p for
    a sale. The second one passes at the threshold, and if it is missing. The
    confidence is the lesser of the two, or the first alone. Without a direction
    nothing passes and there is no confidence.
    """
    side = lambda x: F.when(direction > 0, x).when(direction < 0, 1 - x)
    agrees = (direction != 0) & (p_entry.isNull() | F.coalesce(side(p_entry) >= threshold, F.lit(False)))
    return agrees, F.least(side(p), side(p_entry))


def bracket_prices(rows: DataFrame, atr: str, slip: float = 0.05, tp: float = 2.0, sl: float = 1.0, atr_cap: float = 0.02, most_loss: float = 0.01, spread: Column | None = None, tp_spreads: float = 5.0, sl_spreads: float = 3.0) -> DataFrame:
    """entry, tp and sl prices of a direction: ATR capped at a share of the price and never 0, the loss capped at another share of the entry.

    With a spread, target and stop lie at least tp_spreads and sl_spreads of it away.
    """
    a = F.greatest(F.least(F.col(atr), F.greatest(F.abs("c"), F.lit(1e-8)) * atr_cap), F.lit(1e-8))
    d = F.col("direction")
    rows = rows.withColumns({"entry_px": F.col("c") + d * slip * a, "__a": a})
    gain, loss = tp * F.col("__a"), F.least(sl * F.col("__a"), F.greatest(F.abs("entry_px"), F.lit(1e-8)) * most_loss)
    if spread is not None:
        gain, loss = F.greatest(gain, tp_spreads * spread), F.greatest(loss, sl_spreads * spread)
    return rows.withColumns({"tp_px": F.col("entry_px") + d * gain, "sl_px": F.col("entry_px") - d * loss}).drop("__a")


# Fixed values of the gates: net score, confidence, ATR ratio from and to, agreement, spectral gap; the regime that closes them.
NET, CONFIDENCE, ATR_FROM, ATR_TO, AGREEMENT, GAP, CLOSED = 0.15, 0.55, 0.3, 2.8, 0.5, 0.004, "FRAGMENTED"


def six_gates(rows: DataFrame) -> DataFrame:
    """Six boolean gates and all_pass; needs net, confidence, trend, direction, atr_ratio, agreement, regime (by name) and gap. A null closes its gate."""
    gates = {
        "g_net": F.abs("net") >= NET,
        "g_conf": F.col("confidence") >= CONFIDENCE,
        "g_trend": ((F.col("direction") > 0) & (F.col("trend") > 0)) | ((F.col("direction") < 0) & (F.col("trend") < 0)),
        "g_atr": F.col("atr_ratio").between(ATR_FROM, ATR_TO),
        "g_agree": F.col("agreement") >= AGREEMENT,
        "g_regime": (F.col("regime") != CLOSED) & (F.col("gap") > GAP),
    }
    rows = rows.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in gates.items()})
    every = F.lit(True)
    for k in gates:
        every = every & F.col(k)
    return rows.withColumn("all_pass", every)


def gate_rates(gated: DataFrame) -> DataFrame:
    names = [c for c in gated.columns if c.startswith("g_")] + ["all_pass"]
    return gated.agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in names))


def topk_candidates(rows: DataFrame, score: Column, k: int) -> DataFrame:
    """The k best rows a bar, ties by symbol, with their rank."""
    w = Window.partitionBy("dt").orderBy(score.desc(), "symbol")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank_by_conviction(rows: DataFrame, p: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("dt").orderBy(F.abs(F.col(p) - 0.5).desc(), "symbol")))


def latest_snapshot(b: DataFrame) -> DataFrame:
    """The newest row of each symbol."""
    rest = [c for c in b.columns if c not in ("symbol", "dt")]
    top = b.groupBy("symbol").agg(F.max_by(F.struct("dt", *rest), "dt").alias("x"))
    return top.select("symbol", "x.*")


def exposure_cap(rows: DataFrame, score: str, cap: int, opened: DataFrame | None = None) -> DataFrame:
    """Greedy acceptance within a bar by score, ties by symbol: refused when `cap` accepted or open positions share a currency.

    opened: (dt, symbol), positions open at a bar. The fold holds one bar's
    symbols, of which there are at most as many as instruments.
    """
    legs = F.array(F.substring("symbol", 1, 3), F.substring("symbol", 4, 3))
    item = F.struct((-F.col(score)).alias("k"), "symbol", legs.alias("legs"))
    held = rows.groupBy("dt").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = "array<struct<symbol:string,legs:array<string>>>"
    before = F.array().cast(kind)
    if opened is not None:
        held = held.join(opened.groupBy("dt").agg(F.collect_list(F.struct("symbol", legs.alias("legs"))).alias("open")), "dt", "left")
        before = F.coalesce("open", before)
    busy = lambda s, x: F.size(F.filter(s, lambda y: F.arrays_overlap(y["legs"], x["legs"])))
    taken = F.aggregate("items", before, lambda s, x: F.when(busy(s, x) < cap, F.concat(s, F.array(F.struct(x["symbol"].alias("symbol"), x["legs"].alias("legs"))))).otherwise(s))
    new = F.slice(taken, F.size(before) + 1, F.size("items")) if opened is not None else taken
    return held.select("dt", F.explode(new).alias("x")).select("dt", F.col("x.symbol").alias("symbol"))


def hysteresis(rows: DataFrame, buy: str, sell: str, entry: float = 0.6, leave: float = 0.52, edge: float = 0.0) -> DataFrame:
    """position: flat enters +-1 where its probability reaches entry (and leads by edge), and leaves where it falls below leave; never flips at once.

    A row maps each state to the next one; maps are put together by a scan
    over blocks of rows, so neither a long hold nor a long series lies in one task.
    """
    b, s = F.col(buy), F.col(sell)
    enter = F.when((b >= entry) & (b - s >= edge), 1).when((s >= entry) & (s - b >= edge), -1).otherwise(0)
    step = _state_map(F.when(s < leave, 0).otherwise(-1), enter, F.when(b < leave, 0).otherwise(1))
    ends = lambda m, x: _state_after(m, F.lit(x))
    constant = lambda m: (ends(m, -1) == ends(m, 0)) & (ends(m, 0) == ends(m, 1))
    return composed(rows, step, _then, _state_map(*map(F.lit, (-1, 0, 1))), _state_after, constant, F.lit(0), "position")


def _state_map(short: Column, none: Column, long: Column) -> Column:
    """Where the states -1, 0 and 1 go, as the digits of a number to base 3."""
    return ((short + 1) * 9 + (none + 1) * 3 + (long + 1)).cast("int")


def _state_after(m: Column, state: Column) -> Column:
    return (F.floor(m / F.when(state < 0, 9).when(state > 0, 1).otherwise(3)) % 3).cast("int") - 1


def _then(first: Column, second: Column) -> Column:
    """The map of two maps in turn."""
    return _state_map(*(_state_after(second, _state_after(first, F.lit(x))) for x in (-1, 0, 1)))


def sized_signal(direction: Column, confidence: Column, regime_scale: Column) -> Column:
    """0 without a direction."""
    return F.coalesce(direction * confidence, F.lit(0.0)) * regime_scale


def order_events(scored: DataFrame) -> DataFrame:
    """Valid rows outside closed sessions with direction from p and the columns an order needs."""
    open_ = scored.where("session_code <> 0 and real")
    return open_.select("symbol", "dt", F.when(F.col("p") >= 0.5, 1).otherwise(-1).alias("direction"), "p", "c", "sp", "tk", "session_code")


# The sessions' names by code, and an order state's columns in order.
SESSIONS = ("closed", "tokyo", "london", "newyork", "overlap")
STATE = (
    "prob_buy", "prob_entry", "atr", "volatility", "spread", "tick_count", *(f"session_{s}" for s in SESSIONS),
    "tpo_poc_distance_atr", "tpo_value_area_width_atr", "tpo_balance_score", "tpo_support_score", "tpo_resistance_score", "tpo_rejection_score", "tpo_poc_drift_atr", "tpo_value_area_overlap",
    "tick_velocity_mean", "tick_velocity_std", "spread_z_mean", "spread_z_last", "bid_ask_imbalance_mean", "bid_ask_imbalance_abs_max", "price_velocity_last",
)


def order_state(events: DataFrame, micro: DataFrame) -> DataFrame:
    """events with the 26 columns of STATE; micro: interval_join_window's seven features keyed (symbol, dt).

    events: p, p_entry (may be null: .5), atr, volatility, sp, tk, session_code
    and the eight features of tpo_memory. A code that is no session gives zeros.
    """
    hot = {f"session_{s}": F.coalesce((F.col("session_code") == i).cast("double"), F.lit(0.0)) for i, s in enumerate(SESSIONS)}
    own = {"prob_buy": F.col("p"), "prob_entry": F.coalesce("p_entry", F.lit(0.5)), "spread": F.col("sp"), "tick_count": F.col("tk").cast("double")}
    return events.join(micro, ["symbol", "dt"], "left").withColumns(hot | own).select("symbol", "dt", "direction", *STATE)


def market_neutral(rows: DataFrame, raw: str, gross: float = 1.0) -> DataFrame:
    """Weights of a bar less their mean, scaled to a gross exposure."""
    w = Window.partitionBy("dt")
    rows = rows.withColumn("__w", F.col(raw) - F.avg(raw).over(w))
    return rows.withColumn("weight", F.coalesce(F.try_divide(F.col("__w") * gross, F.sum(F.abs("__w")).over(w)), F.lit(0.0))).drop("__w")


def weights_to_confidence(w: Column, scale: float = 10.0) -> tuple[Column, Column]:
    return 1 / (1 + F.exp(-F.abs(w) * scale)), F.signum(w).cast("int")


def kelly_capped(rows: DataFrame, fraction: str, cap: float) -> DataFrame:
    """Fractions scaled down so that a bar's sum stays within cap."""
    total = F.sum(fraction).over(Window.partitionBy("dt"))
    return rows.withColumn("stake", F.when(total > cap, F.col(fraction) * cap / total).otherwise(F.col(fraction)))


# How far outside the value area a reversal begins, in ATR; what blocks it: another model's confidence, ATR over price, spread over ATR.
OUTSIDE, MOST_OTHER, MOST_ATR_SHARE, MOST_SPREAD_SHARE = 0.08, 0.14, 0.0017, 0.22


def reversal_decision(rows: DataFrame, least_bars: int = 48) -> DataFrame:
    """direction, confidence, tp_dist, sl_dist, lots and reason of a reversal at the edge of the remembered value area.

    Needs c, sp, atr, ret_1, ret_3, n (bars so far), other_direction and
    other_confidence (another model's, which guards), and tpo_memory's columns.
    A buy needs a price OUTSIDE * atr below the area, a rise that three bars
    bear out by a quarter of the last, and a support of more than .1; a sale
    mirrors it. The last guard that holds gives the reason.
    """
    c, sp, atr = F.col("c"), F.col("sp"), F.col("atr")
    safe = F.when(atr > 1e-6, atr)
    side = lambda up, down, none: F.when(F.col("__raw") > 0, up).when(F.col("__raw") < 0, down).otherwise(none)
    buy = (c < F.col("val") - OUTSIDE * atr) & (F.col("ret_1") > 0) & (F.col("ret_3") > 0.25 * F.col("ret_1")) & (F.col("tpo_support_score") > 0.1)
    sell = (c > F.col("vah") + OUTSIDE * atr) & (F.col("ret_1") < 0) & (F.col("ret_3") < 0.25 * F.col("ret_1")) & (F.col("tpo_resistance_score") > 0.1)
    conflict = (F.col("__raw") != 0) & (F.col("other_direction") == -F.col("__raw")) & (F.col("other_confidence") >= 0.75 * MOST_OTHER)
    reason = (
        F.when(safe.isNull(), "degenerate_atr").when(F.col("n") < least_bars, "insufficient_history").when(conflict, "legacy_direction_conflict")
        .when(F.try_divide(sp, safe) >= MOST_SPREAD_SHARE, "spread_stress").when(F.try_divide(atr, F.greatest(F.abs(c), F.lit(1e-8))) >= MOST_ATR_SHARE, "atr_volatility")
        .when(F.col("other_confidence") >= MOST_OTHER, "legacy_high_confidence").otherwise("")
    )
    enough = safe.isNotNull() & (F.col("n") >= least_bars)
    r = rows.withColumn("__raw", F.when(enough & buy, 1).when(enough & sell, -1).otherwise(0)).withColumn("reason", reason)
    r = r.withColumns(
        {
            "__far": F.greatest(F.try_divide(side(F.col("val") - c, c - F.col("vah"), F.lit(0.0)), safe), F.lit(0.0)),
            "__memory": F.least(side(F.col("tpo_support_score"), F.col("tpo_resistance_score"), F.lit(0.0)) + 0.35 * F.col("tpo_rejection_score"), F.lit(1.0)),
            "__trend": F.greatest(side(-F.col("tpo_poc_drift_atr"), F.col("tpo_poc_drift_atr"), F.lit(0.0)) - 0.85, F.lit(0.0)),
            "__go": (F.col("__raw") != 0) & (F.col("reason") == ""),
        }
    )
    score = 0.16 + 0.24 * F.col("__far") + 0.24 * F.try_divide(F.abs("ret_1"), safe) + 0.16 * F.col("tpo_balance_score") + 0.16 * F.col("__memory") + 0.08 * F.greatest("tpo_value_area_overlap", F.lit(0.0)) - 0.1 * F.col("__trend")
    lots = clip(0.5 + 0.25 * F.col("__far") + 0.2 * F.col("__memory") + 0.1 * F.try_divide(F.abs(F.col("long_poc") - F.col("poc")), safe), 0.45, 1.35)
    none = F.greatest(sp, F.lit(1e-6))
    target = F.when(F.col("__raw") != 0, F.greatest(F.abs(F.col("poc") - c), F.abs(F.col("long_poc") - c), 0.9 * atr, 4 * sp)).otherwise(F.greatest(0.9 * atr, 4 * sp))
    stop = F.when(F.col("__raw") != 0, F.greatest(0.6 * F.abs(side(F.col("deep_val"), F.col("deep_vah"), c) - c), 0.65 * atr, 3 * sp)).otherwise(F.greatest(0.65 * atr, 3 * sp))
    r = r.withColumns(
        {
            "direction": F.when(F.col("__go"), F.col("__raw")).otherwise(0), "confidence": F.when(F.col("__go"), F.least(score, F.lit(0.96))).otherwise(0.0), "lots": F.when(F.col("__go"), lots).otherwise(0.0),
            "tp_dist": F.when(safe.isNull(), none).when(F.col("n") < least_bars, F.greatest(atr, sp)).otherwise(target), "sl_dist": F.when(safe.isNull(), none).when(F.col("n") < least_bars, F.greatest(0.75 * atr, sp)).otherwise(stop),
        }
    )
    return r.drop("__raw", "__far", "__memory", "__trend", "__go")


def bar_exit(o: Column, h: Column, low: Column, c: Column, direction: Column, tp: Column, sl: Column) -> Column:
    """Which of tp and sl a bar reaches first: if both, the one nearer to the open, at equal distance the one the close favours."""
    hit_tp = F.when(direction > 0, h >= tp).otherwise(low <= tp)
    hit_sl = F.when(direction > 0, low <= sl).otherwise(h >= sl)
    to_tp, to_sl = F.abs(tp - o), F.abs(sl - o)
    both = F.when(to_tp < to_sl, "tp").when(to_sl < to_tp, "sl").when(direction * (c - o) > 0, "tp").otherwise("sl")
    return F.when(hit_tp & hit_sl, both).when(hit_tp, "tp").when(hit_sl, "sl").otherwise("open")


def path_exit(path: Column, direction: Column, tp: Column, sl: Column) -> Column:
    """The first of tp and sl along a tick path."""
    def touch(x: Column) -> Column:
        up = F.when(direction > 0, x >= tp).otherwise(x <= tp)
        down = F.when(direction > 0, x <= sl).otherwise(x >= sl)
        return F.when(up, "tp").when(down, "sl").otherwise("open")

    return F.aggregate(path, F.lit("open"), lambda s, x: F.when(s != "open", s).otherwise(touch(x)))
