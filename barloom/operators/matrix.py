"""Wide rows: named columns of many symbols on one row a bar, and what two groups of symbols tell each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators.carry import in_blocks
from barloom.operators.quantiles import kept

#: Features of the graph of a bar, in order.
GRAPH_FEATURES = "res_mean res_std res_max gap beta0 beta1 corr_abs trace".split()


def sampled_bars(b: DataFrame, start: int = 120, step: int = 15) -> DataFrame:
    """(dt): each step-th of the distinct times after the first `start`; one row a bar is numbered."""
    n = F.row_number().over(Window.orderBy("dt")) - 1
    return b.select("dt").distinct().withColumn("__n", n).where(f"__n >= {start} and (__n - {start}) % {step} = 0").select("dt")


def feature_matrix(pairs: DataFrame, tradable: list[str], others: DataFrame, informing: list[str], graph: DataFrame, labels: DataFrame, bars: DataFrame) -> DataFrame:
    """(dt, SYMBOL_feature..., graph features, label): a row each of `bars` at which anything is known.

    pairs: pair_features_16 of tradable symbols, others: signal_features_7 of
    informing ones, both (symbol, dt, features...); graph: (dt, features...);
    labels: (dt, label). Only the wanted bars are shuffled, once, by dt: a
    symbol's features travel as one struct and are named after the aggregation,
    so the number of columns costs no pivot. A missing symbol has nulls.
    """
    own, more = F.struct(*ind.PAIR_FEATURES).alias("x16"), F.struct(*ind.SIGNAL_FEATURES).alias("x7")
    long = pairs.where(F.col("symbol").isin(tradable)).select("dt", "symbol", own).unionByName(others.where(F.col("symbol").isin(informing)).select("dt", "symbol", more), allowMissingColumns=True)
    cells = [(s, "x16", ind.PAIR_FEATURES) for s in tradable] + [(s, "x7", ind.SIGNAL_FEATURES) for s in informing]
    held = long.join(bars, "dt", "left_semi").groupBy("dt").agg(*(F.any_value(F.when(F.col("symbol") == s, F.col(x)), True).alias(f"__{i}") for i, (s, x, _) in enumerate(cells)))
    wide = held.select("dt", *(F.col(f"__{i}")[f].alias(f"{s}_{f}") for i, (s, _, fs) in enumerate(cells) for f in fs))
    return wide.join(graph, "dt", "left").join(labels.select("dt", "label"), "dt", "left")


#: What the lead symbol tells the group, before its gate; what the group tells it; what both share.
TO_GROUP = "btc_weekend_regime btc_weekend_regime_shift btc_vol_percentile btc_risk_sentiment btc_spectral_gap_delta btc_tick_velocity_z btc_spread_z btc_h1_lifespan".split()
TO_LEAD = "fx_session_phase fx_regime_summary fx_dxy_proxy fx_avg_spread_z fx_jpy_cross_mean_ret fx_spectral_gap".split()
SHARED = "graph_betti_0 graph_betti_1 graph_max_h1_life graph_spectral_gap graph_regime prev_regime bars_in_regime session_transition regime_ema".split()


def _windows(b: DataFrame, horizon: int, gap_bars: int) -> DataFrame:
    b = ind.inner(ind.gap_delta)(ind.inner(ind.horizon_return)(b, horizon), "gap", gap_bars)
    return ind.inner(ind.z_past)(ind.inner(ind.z_past)(b, "tk", 60), "sp", 60)


def cross_bridge(lead: DataFrame, group: DataFrame, state: DataFrame, basket: dict[str, float], crosses: list[str], phase: Column, gate: Column, horizon: int = 240, history: int = 43_200, gap_bars: int = 60) -> DataFrame:
    """(dt, 24 columns): what a lead symbol and a group of symbols tell each other at each of the lead's bars.

    lead: (symbol, dt, c, sp, tk, atr) of one symbol; group: (symbol, dt, ret,
    sp); state: (dt, beta0, beta1, h1, gap, regime) of the graph, regime being
    a code 0 to 4 in order of severity; basket: weights of the symbols in the
    currency proxy; crosses: symbols whose mean return is told apart. phase
    gives a session phase's code and gate the weight in [0, 1] that multiplies
    the eight columns for the group, both from dt and regime.

    All series are scans and windows over blocks of the lead's bars; the
    group is summed to one row a bar first.
    """
    b = lead.join(state, "dt", "left").withColumn("phase_code", phase)
    b = in_blocks(b, max(horizon, gap_bars, 60), lambda x: _windows(x, horizon, gap_bars))
    for step in (lambda x: ind.weekend_carry(x, "regime"), lambda x: ind.vol_percentile(x, "atr", history), lambda x: ind.regime_memory(x, "regime", "phase_code")):
        b = step(kept(b))  # each scan reads its rows twice: without a cut a chain of them would read them 2^n times
    b = kept(b)
    group = in_blocks(group, 60, lambda x: ind.inner(ind.z_past)(x, "sp", 60))
    weight = F.create_map(*(F.lit(x) for pair in basket.items() for x in pair)) if basket else F.create_map().cast("map<string,double>")
    w = F.try_element_at(weight, F.col("symbol"))
    sums = group.groupBy("dt").agg(
        F.avg("ret").alias("fx_regime_summary"), F.try_divide(F.sum(w * F.col("ret")), F.sum(F.abs(w))).alias("fx_dxy_proxy"), F.avg("sp_z60").alias("fx_avg_spread_z"), F.avg(F.when(F.col("symbol").isin(crosses), F.col("ret"))).alias("fx_jpy_cross_mean_ret")
    )
    b = b.join(sums, "dt", "left").withColumn("__gate", gate)
    told = [F.col("weekend_regime"), F.col("weekend_shift"), F.col("vol_pct"), F.col(f"ret_h{horizon}"), F.col("gap_delta"), F.col("tk_z60"), F.col("sp_z60"), F.col("h1")]
    gated = {n: c.cast("double") * F.col("__gate") for n, c in zip(TO_GROUP, told, strict=True)} | {"btc_bridge_gate": F.col("__gate")}
    heard = {n: F.coalesce(F.col(n), F.lit(0.0)) for n in TO_LEAD[1:5]} | {"fx_session_phase": F.col("phase_code").cast("double"), "fx_spectral_gap": F.coalesce("gap", F.lit(0.0))}
    own = [F.coalesce("beta0", F.lit(1)), F.coalesce("beta1", F.lit(0)), F.coalesce("h1", F.lit(0.0)), F.coalesce("gap", F.lit(0.0)), F.coalesce("regime", F.lit(2)), F.col("regime_before"), F.col("regime_age"), F.col("session_transition").cast("int"), F.col("regime_ema")]
    shared = {n: c.cast("double") for n, c in zip(SHARED, own, strict=True)}
    made = gated | heard | shared
    return b.select("dt", *(made[n].alias(n) for n in (*TO_GROUP, "btc_bridge_gate", *TO_LEAD, *SHARED)))
