"""Queries of signals, gates, rankings and state machines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import calendar, numeric
from barloom.operators import align, bars, profile, signals
from barloom.operators import indicators as ind
from barloom.plans import graph_queries  # noqa: F401 (its SQL is used below)
from barloom.plans.bar_queries import MICRO_SQL, micro_bars
from barloom.plans.indicator_queries import ALL, KEY, RN, SESSION, TR, over
from barloom.plans.registry import SQL, hourly, query, quotes, returns, scored, table

DIR = "CASE WHEN greatest(p, 1 - p) > 1.01 OR abs(2 * p - 1) < 0.15 THEN 0 WHEN p >= least(greatest(0.65 + 12 * vol, 0.5), 0.9) THEN 1 WHEN p <= 1 - least(greatest(0.65 + 12 * vol, 0.5), 0.9) THEN -1 ELSE 0 END"
SCORED = f"(SELECT id, symbol, dt, p, y, fwd, (id % 7) / 470.0::DOUBLE AS vol, ((id * 37) % 101) / 100.0::DOUBLE AS p2, {DIR.replace('vol', '((id % 7) / 470.0::DOUBLE)')} AS direction FROM scored)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).withColumns({"vol": F.col("id") % 7 / 470, "p2": F.col("id") * 37 % 101 / 100})
    return s.withColumn("direction", signals.entry_direction(F.col("p"), F.col("vol")))


@query("tradable_guard", "id:i symbol:s p:d", "SELECT id, symbol, p FROM scored WHERE symbol NOT IN ('error', 'signup')")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    return signals.tradable_guard(s, s.select("symbol").distinct().withColumn("tradable", ~F.col("symbol").isin("error", "signup")))


@query("session_pair_filter", "id:i symbol:s", "SELECT id, symbol FROM scored WHERE (symbol < 'p' AND hour(dt) >= 2 AND hour(dt) < 9) OR (symbol >= 'p' AND hour(dt) >= 13 AND hour(dt) < 22)")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    early = F.col("symbol") < "p"
    return signals.session_pair_filter(s, s.select("symbol").distinct().withColumns({"lo": F.when(early, 2).otherwise(13), "hi": F.when(early, 9).otherwise(22)}))


@query("entry_direction", "id:i direction:i", f"SELECT id, direction FROM {SCORED}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


@query("entry_gate", "id:i agrees:b confidence:d", f"""SELECT id, direction <> 0 AND (q IS NULL OR coalesce(CASE WHEN direction > 0 THEN q WHEN direction < 0 THEN 1 - q END >= 0.55, false)) AS agrees,
  least(CASE WHEN direction > 0 THEN p WHEN direction < 0 THEN 1 - p END, CASE WHEN direction > 0 THEN q WHEN direction < 0 THEN 1 - q END) AS confidence FROM (SELECT *, CASE WHEN id % 10 <> 0 THEN p2 END AS q FROM {SCORED})""")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).withColumn("q", F.when(F.col("id") % 10 != 0, F.col("p2")))
    agrees, conf = signals.entry_gate(F.col("direction"), F.col("q"), F.col("p"), 0.55)
    return s.withColumns({"agrees": agrees, "confidence": conf})


SIDE = "CASE WHEN tk % 2 = 0 THEN 1 ELSE -1 END"


BRACKET = f"(SELECT symbol, dt, c, dir, a, sp, c + dir * 0.0517093 * a AS e FROM (SELECT symbol, dt, c, sp, {SIDE} AS dir, greatest(least(CASE WHEN rn >= 3 THEN avg(tr) OVER {over(13)} END, greatest(abs(c), 1e-8) * 0.02), 1e-8) AS a, rn FROM {TR}) WHERE rn >= 3)"


def _bracketed(spark: SparkSession, d: str) -> DataFrame:
    return ind.atr_series(hourly(spark, d)).where("atr_series is not null").withColumn("direction", F.when(F.col("tk") % 2 == 0, 1).otherwise(-1))


@query("bracket_prices", f"{KEY} entry_px:d tp_px:d sl_px:d", f"SELECT symbol, dt, e AS entry_px, e + dir * 2 * a AS tp_px, e - dir * least(a, greatest(abs(e), 1e-8) * 0.0103471) AS sl_px FROM {BRACKET}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return signals.bracket_prices(_bracketed(spark, d), "atr_series", slip=0.0517093, most_loss=0.0103471)


@query("bracket_by_spread", f"{KEY} entry_px:d tp_px:d sl_px:d", f"SELECT symbol, dt, e AS entry_px, e + dir * greatest(2 * a, 5 * 40 * sp) AS tp_px, e - dir * greatest(least(1.5 * a, greatest(abs(e), 1e-8) * 0.0103471), 3 * 40 * sp) AS sl_px FROM {BRACKET}")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Spreads of the events are small against their ATR; forty of them count as one."""
    return signals.bracket_prices(_bracketed(spark, d), "atr_series", slip=0.0517093, sl=1.5, most_loss=0.0103471, spread=40 * F.col("sp"))


GATED = f"(SELECT symbol, dt, ret AS net, 0.5 + least(abs(ret), 1) / 2 AS conf, sum(ret) OVER {over(4)} AS trend, {SIDE} AS dir, sp / avg(sp) OVER {over(59)} AS ar, tk / 5.0 AS ag, CASE WHEN tk % 5 = 4 THEN 'FRAGMENTED' ELSE 'NORMAL' END AS rg, 0.002 * tk AS gap FROM rets)"
GATES = "abs(net) >= 0.15 AS g_net, conf >= 0.55 AS g_conf, (dir > 0 AND trend > 0) OR (dir < 0 AND trend < 0) AS g_trend, ar BETWEEN 0.3 AND 2.8 AS g_atr, ag >= 0.5 AS g_agree, rg <> 'FRAGMENTED' AND gap > 0.004 AS g_regime"


def _gated(spark: SparkSession, d: str) -> DataFrame:
    r = returns(spark, d)
    rows = r.select(
        "symbol", "dt", F.col("ret").alias("net"), (0.5 + F.least(F.abs("ret"), F.lit(1.0)) / 2).alias("confidence"), F.sum("ret").over(ind.rows(-4)).alias("trend"), F.when(F.col("tk") % 2 == 0, 1).otherwise(-1).alias("direction"),
        (F.col("sp") / F.avg("sp").over(ind.rows(-59))).alias("atr_ratio"), (F.col("tk") / 5.0).alias("agreement"), F.when(F.col("tk") % 5 == 4, "FRAGMENTED").otherwise("NORMAL").alias("regime"), (0.002 * F.col("tk")).alias("gap"),
    )
    return signals.six_gates(rows)


@query("six_gates", f"{KEY} g_net:b g_conf:b g_trend:b g_atr:b g_agree:b g_regime:b all_pass:b", f"SELECT *, g_net AND g_conf AND g_trend AND g_atr AND g_agree AND g_regime AS all_pass FROM (SELECT symbol, dt, {GATES} FROM {GATED})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d)


@query("gate_rates", "g_net:d g_conf:d all_pass:d", f"SELECT avg(g_net::INT) AS g_net, avg(g_conf::INT) AS g_conf, avg((g_net AND g_conf AND g_trend AND g_atr AND g_agree AND g_regime)::INT) AS all_pass FROM (SELECT {GATES} FROM {GATED})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return signals.gate_rates(_gated(spark, d))


@query("tpo_reversal_decision", f"{KEY} direction:i confidence:d tp_dist:d sl_dist:d lots:d reason:s")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = ind.log_ret(ind.log_ret(ind.atr_series(hourly(spark, d)), 1), 3).withColumns({"atr": F.coalesce("atr_series", F.lit(0.0)), "n": F.row_number().over(ind.by_time())})
    m = profile.tpo_memory(b, "atr").withColumns({"other_direction": (F.col("tk") % 3 - 1).cast("int"), "other_confidence": F.col("tk") % 4 * 0.045})
    return signals.reversal_decision(m)


EVENTS = f"(SELECT symbol, dt, CASE WHEN p >= 0.5 THEN 1 ELSE -1 END AS direction, p, c, sp, tk, sc FROM (SELECT *, (tk % 11) / 10.0::DOUBLE AS p, {SESSION.format('dt')} AS sc FROM bars) WHERE sc <> 0 AND tk > 1)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return signals.order_events(hourly(spark, d).withColumns({"p": F.col("tk") % 11 / 10, "session_code": calendar.session_code(F.col("dt")), "real": F.col("tk") > 1}))


@query("order_events", f"{KEY} direction:i p:d c:d sp:d tk:i session_code:i", f"SELECT symbol, dt, direction, p, c, sp, tk, sc AS session_code FROM {EVENTS}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d)


@query(
    "order_state_26", " ".join([KEY, "direction:i", *(f"{c}:d" for c in signals.STATE)]),
    f"""SELECT e.symbol, e.dt, direction, p AS prob_buy, coalesce(CASE WHEN tk % 3 <> 0 THEN (tk % 7) / 7.0::DOUBLE END, 0.5) AS prob_entry, coalesce(a.atr_series, 0) AS atr, v.vol_24 AS volatility, sp AS spread, tk AS tick_count,
      {', '.join(f'(sc = {i})::INT AS session_{n}' for i, n in enumerate(signals.SESSIONS))}, t.* EXCLUDE (symbol, dt), {', '.join(align.MICRO)}
      FROM {EVENTS} e JOIN ({SQL['atr_series']}) a ON a.symbol = e.symbol AND a.dt = e.dt JOIN ({SQL['rolling_vol_24']}) v ON v.symbol = e.symbol AND v.dt = e.dt
      JOIN ({SQL['tpo_memory_8']}) t ON t.symbol = e.symbol AND t.dt = e.dt JOIN ({MICRO_SQL}) m ON m.symbol = e.symbol AND m.dt = e.dt""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    b = ind.rolling_vol_24(ind.atr_series(hourly(spark, d))).withColumns({"atr": F.coalesce("atr_series", F.lit(0.0)), "volatility": F.col("vol_24"), "p_entry": F.when(F.col("tk") % 3 != 0, F.col("tk") % 7 / 7)})
    more = profile.tpo_memory(b, "atr").select("symbol", "dt", "atr", "volatility", "p_entry", *profile.MEMORY[:8])
    micro = align.interval_join_window(b.select("symbol", "dt"), micro_bars(spark, d), 3600)
    return signals.order_state(_events(spark, d).join(more, ["symbol", "dt"]), micro)


@query("topk_candidates", "dt:t symbol:s rank:i score:d", "SELECT * FROM (SELECT dt, symbol, abs(ret) * tk AS score, row_number() OVER (PARTITION BY dt ORDER BY abs(ret) * tk DESC, symbol) AS rank FROM rets) WHERE rank <= 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = returns(spark, d).withColumn("score", F.abs("ret") * F.col("tk"))
    return signals.topk_candidates(r, F.col("score"), 2)


@query("rank_by_conviction", "dt:t symbol:s rank:i", "SELECT dt, symbol, row_number() OVER (PARTITION BY dt ORDER BY abs((tk % 11) / 10.0::DOUBLE - 0.5) DESC, symbol) AS rank FROM bars")
def _(spark: SparkSession, d: str) -> DataFrame:
    return signals.rank_by_conviction(hourly(spark, d).withColumn("p", F.col("tk") % 11 / 10), "p")


@query("latest_snapshot", "symbol:s dt:t c:d", "SELECT symbol, max(dt) AS dt, arg_max(c, dt) AS c FROM bars GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return signals.latest_snapshot(hourly(spark, d))


@query("exposure_cap", "dt:t symbol:s")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").where("length(p_name) >= 6").select(F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.col("p_size"), F.lit(0)).alias("dt"), F.upper(F.substring("p_name", 1, 6)).alias("symbol"), "p_retailprice")
    best = p.groupBy("dt", "symbol").agg(F.max("p_retailprice").alias("score"))
    opened = table(spark, d, "part").where("length(p_name) >= 6 and p_partkey % 40 = 0").select(F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.col("p_size"), F.lit(0)).alias("dt"), F.upper(F.substring("p_name", 2, 6)).alias("symbol"))
    return signals.exposure_cap(best, "score", 2, opened)


@query("hysteresis_signal", "id:i position:i")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).withColumn("q", 1 - F.col("p"))
    return signals.hysteresis(s, "p", "q", 0.6, 0.52)


@query("sized_signal", "id:i signal:d", f"SELECT id, coalesce(direction * least(CASE WHEN direction > 0 THEN p WHEN direction < 0 THEN 1 - p END, CASE WHEN direction > 0 THEN p2 WHEN direction < 0 THEN 1 - p2 END), 0) * CASE id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 ELSE 0.0 END AS signal FROM {SCORED}")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    r = F.col("id") % 4
    scale = F.when(r == 0, 1.0).when(r == 1, 0.7).when(r == 2, 0.4).otherwise(0.0)
    return s.withColumn("signal", signals.sized_signal(F.col("direction"), signals.entry_gate(F.col("direction"), F.col("p2"), F.col("p"))[1], scale))


WEIGHT = "(SELECT *, w / nullif(sum(abs(w)) OVER (PARTITION BY dt), 0) AS weight FROM (SELECT *, ret - avg(ret) OVER (PARTITION BY dt) AS w FROM rets WHERE dt IN (SELECT dt FROM bars GROUP BY 1 HAVING count(*) = 5)))"


@query("weights_to_confidence", "dt:t symbol:s weight:d confidence:d side:i", f"SELECT dt, symbol, coalesce(weight, 0) AS weight, 1 / (1 + exp(-abs(coalesce(weight, 0)) * 10)) AS confidence, sign(coalesce(weight, 0)) AS side FROM {WEIGHT}")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = signals.market_neutral(align.align_intersect(returns(spark, d)), "ret")
    conf, side = signals.weights_to_confidence(F.col("weight"))
    return w.withColumns({"confidence": conf, "side": side})


@query("kelly_fraction", f"{KEY} stake:d", "SELECT symbol, dt, CASE WHEN sum(f) OVER (PARTITION BY dt) > 0.1 THEN f * 0.1 / sum(f) OVER (PARTITION BY dt) ELSE f END AS stake FROM (SELECT symbol, dt, least(greatest((1.5 * p - (1 - p)) / 1.5 * 0.5, 0), 0.1) AS f FROM (SELECT *, (tk % 11) / 10.0::DOUBLE AS p FROM bars))")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = hourly(spark, d).withColumn("f", numeric.kelly_fraction(F.col("tk") % 11 / 10, F.lit(1.5)))
    return signals.kelly_capped(b, "f", 0.1)


@query("scalar_costs", f"{KEY} cost:d stress:d lots:d scale:d", f"SELECT symbol, dt, greatest(CASE WHEN sp < 50 * 0.0001 THEN sp ELSE sp * 0.0001 / 10 END, 0) AS cost, sp / nullif(c, 0) + 1 / sqrt(tk + 1) AS stress, least(greatest(1000 * 0.01 / (h - l + 1), 0.01), 10) AS lots, CASE tk % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.4 END AS scale FROM bars")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("tk") % 3
    return hourly(spark, d).withColumns({
        "cost": numeric.spread_cost(F.col("sp"), F.col("c"), F.lit(0.0001)), "stress": numeric.liquidity_stress(F.col("sp"), F.col("c"), F.col("tk")),
        "lots": numeric.position_size(F.lit(1000.0), 0.01, F.col("h") - F.col("l") + 1, F.lit(1.0)), "scale": F.when(r == 0, 1.0).when(r == 1, 0.7).otherwise(0.4),
    })


MARKS = {"rsi": (55, 45), "macd": (0, 0), "bb_pct_b": (0.6, 0.4), "stoch_k": (60, 40), "cci": (50, -50), "willr": (-40, -60), "mom5": (0.3, -0.3)}
VOTES = f"(SELECT symbol, dt, {' + '.join(f'CASE WHEN {c} > {u} THEN 1 WHEN {c} < {v} THEN -1 ELSE 0 END' for c, (u, v) in MARKS.items())} AS votes FROM ({SQL['pair_features_16']}))"


def _votes(spark: SparkSession, d: str) -> DataFrame:
    b = ind.pair_features_16(hourly(spark, d), numeric.pip_size(F.col("symbol.name")))
    return b.withColumns({"votes": numeric.indicator_votes({v: F.col(c) for v, c in zip(numeric.VOTES, MARKS, strict=True)}), "ret_1": F.coalesce("log_ret", F.lit(0.0))})


@query("indicator_votes", f"{KEY} votes:i side:i", f"SELECT *, CASE WHEN votes >= 3 THEN 1 WHEN votes <= -3 THEN -1 ELSE 0 END AS side FROM {VOTES}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _votes(spark, d).withColumn("side", numeric.vote_direction(F.col("votes")))


@query("confidence_proxy", f"{KEY} confidence:d", f"SELECT symbol, dt, least(greatest(0.4 * least(abs(votes) / 7.0, 1) + 0.35 * least(abs(ret) / 5e-4, 1) + 0.25 * CASE WHEN streak >= 3 THEN least(streak / 5.0, 0.3) ELSE 0 END, 0), 1) AS confidence FROM {VOTES} JOIN (SELECT symbol, dt, ret FROM rets) USING (symbol, dt) JOIN ({SQL['residual_streak']}) USING (symbol, dt)")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = ind.residual_streak(_votes(spark, d), "ret_1", 0.05)
    return r.withColumn("confidence", numeric.confidence_proxy(F.col("votes"), F.col("ret_1"), F.col("streak")))


@query("regime_scale", f"{KEY} of_name:d of_code:d", "SELECT symbol, dt, CASE tk % 6 WHEN 2 THEN 0.7 WHEN 3 THEN 0.5 WHEN 4 THEN 0.3 ELSE 1.0 END AS of_name, CASE tk % 6 WHEN 2 THEN 0.75 WHEN 3 THEN 0.55 WHEN 4 THEN 0.35 WHEN 5 THEN 0.35 ELSE 1.0 END AS of_code FROM bars")
def _(spark: SparkSession, d: str) -> DataFrame:
    code = (F.col("tk") % 6).cast("int")
    names = F.array(*map(F.lit, numeric.SIGNAL_SCALE))
    return hourly(spark, d).withColumns({"of_name": numeric.regime_scale(F.get(names, code)), "of_code": numeric.regime_scale_of_code(code)})


@query("norm_cdf_ppf", "id:i cdf:d ppf:d", """SELECT id, CASE WHEN x >= 0 THEN 1 - t ELSE t END AS cdf, CASE WHEN p <= 0 OR p >= 1 THEN NULL WHEN p < 0.5 THEN -z ELSE z END AS ppf FROM (SELECT *, k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))) * exp(-x * x / 2) / sqrt(2 * pi()) AS t,
  u - (2.515517 + u * (0.802853 + u * 0.010328)) / (1 + u * (1.432788 + u * (0.189269 + u * 0.001308))) AS z FROM (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(x)) AS k, CASE WHEN p > 0 AND p < 1 THEN sqrt(-2 * ln(least(p, 1 - p))) END AS u FROM (SELECT id, p, p * 6 - 3 AS x FROM scored)))""")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    inside = F.when((p > 0) & (p < 1), p)
    return scored(spark, d).withColumns({"cdf": numeric.norm_cdf(p * 6 - 3), "ppf": numeric.norm_ppf(inside)})


EXIT = f"(SELECT *, lead(o) OVER {ALL} AS o1, lead(h) OVER {ALL} AS h1, lead(l) OVER {ALL} AS l1, lead(c) OVER {ALL} AS c1, {SIDE} AS dir, c * (1 + 0.3 * {SIDE}) AS tp, c * (1 - 0.2 * {SIDE}) AS sl FROM bars)"


@query("bar_exit_resolution", f"{KEY} outcome:s", f"SELECT symbol, dt, CASE WHEN ht AND hs THEN CASE WHEN abs(tp - o1) < abs(sl - o1) THEN 'tp' WHEN abs(sl - o1) < abs(tp - o1) THEN 'sl' WHEN dir * (c1 - o1) > 0 THEN 'tp' ELSE 'sl' END WHEN ht THEN 'tp' WHEN hs THEN 'sl' ELSE 'open' END AS outcome FROM (SELECT *, CASE WHEN dir > 0 THEN h1 >= tp ELSE l1 <= tp END AS ht, CASE WHEN dir > 0 THEN l1 <= sl ELSE h1 >= sl END AS hs FROM {EXIT})")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = hourly(spark, d).withColumn("dir", F.when(F.col("tk") % 2 == 0, 1).otherwise(-1))
    nxt = {f"{c}1": F.lead(c).over(ind.by_time()) for c in "ohlc"}
    b = b.withColumns({**nxt, "tp": F.col("c") * (1 + 0.3 * F.col("dir")), "sl": F.col("c") * (1 - 0.2 * F.col("dir"))})
    return b.withColumn("outcome", signals.bar_exit(*(F.col(x) for x in ("o1", "h1", "l1", "c1", "dir", "tp", "sl"))))


PATH = "(SELECT symbol, dt, o, list_filter(list_transform(path, lambda x: CASE WHEN x >= o * 1.3 THEN 'tp' WHEN x <= o * 0.8 THEN 'sl' END), lambda v: v IS NOT NULL) AS hits FROM (SELECT symbol, date_trunc('hour', ts) AS dt, list(mid ORDER BY id) AS path, arg_min(mid, id) AS o FROM quotes GROUP BY 1, 2))"


@query("path_exit_resolution", f"{KEY} outcome:s", f"SELECT symbol, dt, coalesce(hits[1], 'open') AS outcome FROM {PATH}")
def _(spark: SparkSession, d: str) -> DataFrame:
    q = quotes(spark, d)
    b = hourly(spark, d).join(bars.tick_path(q, "hour"), ["symbol", "dt"])
    return b.withColumn("outcome", signals.path_exit(F.col("path"), F.lit(1), F.col("o") * 1.3, F.col("o") * 0.8))
