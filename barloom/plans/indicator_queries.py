"""Queries of indicators over hourly bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import calendar
from barloom.functions.numeric import pip_size
from barloom.operators import indicators as ind
from barloom.plans.registry import SQL, hourly, query, returns

KEY = "symbol:s dt:t"


def over(n: int, end: str = "CURRENT ROW") -> str:
    """A window of the last n rows, or of n rows before `end`."""
    return f"(PARTITION BY symbol ORDER BY dt ROWS BETWEEN {n} PRECEDING AND {end})"


def ln(a: str, b: str) -> str:
    """ln(a / b), null where either is 0."""
    return f"ln(nullif({a}, 0) / nullif({b}, 0))"


ALL = "(PARTITION BY symbol ORDER BY dt)"
LAG = f"lag(c) OVER {ALL}"
RN = f"row_number() OVER {ALL}"


@query("log_ret", f"{KEY} ret_1:d ret_3:d", f"SELECT symbol, dt, coalesce({ln('c', LAG)}, 0) AS ret_1, coalesce({ln('c', f'lag(c, 3) OVER {ALL}')}, 0) AS ret_3 FROM bars")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.log_ret(ind.log_ret(hourly(spark, d), 1), 3)


@query("log_ret_clamped", f"{KEY} ret_6:d", f"SELECT symbol, dt, coalesce({ln('c', f'coalesce(lag(c, 6) OVER {ALL}, first_value(c) OVER {ALL})')}, 0) AS ret_6 FROM bars")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.log_ret(hourly(spark, d), 6, clamp=True)


@query("price_velocity", f"{KEY} velocity_pct:d", f"SELECT symbol, dt, 100 * coalesce((c - {LAG}) / nullif({LAG} + 1e-10, 0), 0) AS velocity_pct FROM bars")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.price_velocity(hourly(spark, d)).withColumn("velocity_pct", 100 * F.col("price_velocity"))


@query("spread_z_incl", f"{KEY} sp_z:d", f"SELECT symbol, dt, round((sp - avg(sp) OVER {over(59)}) / (coalesce(stddev_samp(sp) OVER {over(59)}, 0) + 1e-10), 4) AS sp_z FROM bars")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.spread_z_incl(hourly(spark, d))


@query("z_past_60", f"{KEY} c_z60:d", f"SELECT symbol, dt, CASE WHEN {RN} <= 2 THEN 0 ELSE coalesce((c - avg(c) OVER {over(60, '1 PRECEDING')}) / (stddev_pop(c) OVER {over(60, '1 PRECEDING')} + 1e-10), 0) END AS c_z60 FROM bars")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = ind.z_past(hourly(spark, d), "c", 60)
    return b.withColumn("c_z60", F.when(F.row_number().over(ind.by_time()) <= 2, 0.0).otherwise(F.col("c_z60")))  # a single earlier row has no deviation


@query("z_past_64", f"{KEY} c_z64:d", f"SELECT symbol, dt, CASE WHEN {RN} <= 2 THEN 0 ELSE coalesce((c - avg(c) OVER {over(64, '1 PRECEDING')}) / sqrt(var_pop(c) OVER {over(64, '1 PRECEDING')} + 1e-8), 0) END AS c_z64 FROM bars")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = ind.z_past(hourly(spark, d), "c", 64, 1e-8, True)
    return b.withColumn("c_z64", F.when(F.row_number().over(ind.by_time()) <= 2, 0.0).otherwise(F.col("c_z64")))


DIFF = f"(SELECT *, c - {LAG} AS df, {RN} AS rn FROM bars)"


@query("rsi", f"{KEY} rsi:d", f"SELECT symbol, dt, CASE WHEN rn < 15 THEN NULL WHEN lo < 1e-10 THEN 100 ELSE 100 - 100 / (1 + up / lo) END AS rsi FROM (SELECT symbol, dt, rn, avg(greatest(df, 0)) OVER {over(13)} AS up, avg(greatest(-df, 0)) OVER {over(13)} AS lo FROM {DIFF})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.rsi(hourly(spark, d))


@query("ema", f"{KEY} ema_12:d", f"SELECT symbol, dt, list_reduce(w, lambda s, x: (2.0::DOUBLE / 13) * x + (1 - 2.0::DOUBLE / 13) * s) AS ema_12 FROM (SELECT symbol, dt, list(c) OVER {over(119)} AS w FROM bars)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.ema(hourly(spark, d), 12, 120)


@query("macd", f"{KEY} macd:d", f"SELECT symbol, dt, CASE WHEN rn >= 35 THEN list_reduce(w, lambda s, x: s + (2.0::DOUBLE / 13) * (x - s)) - list_reduce(w, lambda s, x: s + (2.0::DOUBLE / 27) * (x - s)) END AS macd FROM (SELECT symbol, dt, {RN} AS rn, list(c) OVER {over(119)} AS w FROM bars)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.macd(hourly(spark, d))


STEP = "list_reduce({0}, lambda s, x: s + ({1}.0::DOUBLE / {2}) * (x - s))"
LINE = f"list_transform(range(greatest(len(w) - 18, 1), len(w) + 1), lambda i: {STEP.format('w[1:i]', 2, 13)} - {STEP.format('w[1:i]', 2, 27)})"


@query("macd_signal", f"{KEY} macd_signal:d", f"SELECT symbol, dt, CASE WHEN rn >= 35 THEN list_reduce({LINE}, lambda s, x: 0.2::DOUBLE * x + (1 - 0.2::DOUBLE) * s) END AS macd_signal FROM (SELECT symbol, dt, {RN} AS rn, list(c) OVER {over(119)} AS w FROM bars)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.macd(hourly(spark, d))


@query("bollinger", f"{KEY} pct_b:d bandwidth:d", f"SELECT symbol, dt, CASE WHEN rn < 20 THEN NULL WHEN s < 1e-10 THEN 0.5 ELSE (c - m + 2 * s) / (4 * s) END AS pct_b, CASE WHEN rn < 20 THEN NULL WHEN s < 1e-10 THEN 0 ELSE 4 * s / nullif(m, 0) END AS bandwidth FROM (SELECT *, {RN} AS rn, avg(c) OVER {over(19)} AS m, stddev_samp(c) OVER {over(19)} AS s FROM bars)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.bollinger(hourly(spark, d))


TR = f"(SELECT *, {RN} AS rn, CASE WHEN {LAG} IS NOT NULL THEN greatest(h - l, abs(h - {LAG}), abs(l - {LAG})) END AS tr, greatest(h - l, abs(h - coalesce({LAG}, c)), abs(l - coalesce({LAG}, c))) AS tr0 FROM bars)"


@query("atr_14", f"{KEY} atr_14:d", f"SELECT symbol, dt, CASE WHEN rn >= 15 THEN avg(tr) OVER {over(13)} END AS atr_14 FROM {TR}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.atr_14(hourly(spark, d))


@query("atr_series", f"{KEY} atr_series:d", f"SELECT symbol, dt, CASE WHEN rn >= 3 THEN avg(tr) OVER {over(13)} END AS atr_series FROM {TR}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.atr_series(hourly(spark, d))


@query("atr_norm", f"{KEY} atr_norm:d", f"SELECT symbol, dt, avg(tr0) OVER {over(13)} / nullif(abs(c), 0) AS atr_norm FROM {TR}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.atr_norm(hourly(spark, d))


@query("atr_proxy_24", f"{KEY} atr_proxy:d", f"SELECT symbol, dt, CASE WHEN rn <= 2 THEN h - l ELSE avg(tr) OVER {over(23)} END AS atr_proxy FROM {TR}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.atr_proxy_24(hourly(spark, d))


@query("stochastic", f"{KEY} stoch_k:d stoch_d:d", f"SELECT symbol, dt, CASE WHEN rn >= 20 THEN k END AS stoch_k, CASE WHEN rn >= 20 THEN avg(k) OVER {over(2)} END AS stoch_d FROM (SELECT *, avg(raw) OVER {over(2)} AS k FROM (SELECT symbol, dt, {RN} AS rn, CASE WHEN {RN} < 15 THEN NULL WHEN max(h) OVER {over(14)} - min(l) OVER {over(14)} < 1e-10 THEN 50 ELSE 100 * (c - min(l) OVER {over(14)}) / (max(h) OVER {over(14)} - min(l) OVER {over(14)}) END AS raw FROM bars))")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.stochastic(hourly(spark, d))


@query("cci", f"{KEY} cci:d", f"SELECT symbol, dt, CASE WHEN rn < 20 THEN NULL WHEN dev < 1e-10 THEN 0 ELSE (tp - m) / (0.015 * dev) END AS cci FROM (SELECT *, list_avg(list_transform(w, lambda x: abs(x - m))) AS dev FROM (SELECT *, list(tp) OVER {over(19)} AS w, avg(tp) OVER {over(19)} AS m FROM (SELECT *, (h + l + c) / 3 AS tp, {RN} AS rn FROM bars)))")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.cci(hourly(spark, d))


@query("williams_r", f"{KEY} will_r:d", f"SELECT symbol, dt, CASE WHEN {RN} < 14 THEN NULL WHEN max(h) OVER {over(13)} - min(l) OVER {over(13)} < 1e-10 THEN -50 ELSE -100 * (max(h) OVER {over(13)} - c) / (max(h) OVER {over(13)} - min(l) OVER {over(13)}) END AS will_r FROM bars")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.williams_r(hourly(spark, d))


@query("mom5", f"{KEY} mom5:d", f"SELECT symbol, dt, CASE WHEN rn >= 6 THEN (c - lag(c, 5) OVER {ALL}) / (stddev_pop(df) OVER {over(4)} + 1e-10) END AS mom5 FROM {DIFF}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.mom5(hourly(spark, d))


PIPPED = f"""(SELECT *, lag(c) OVER {ALL} AS before, {RN} AS bar FROM bars)"""


@query(
    "pair_features_16",
    " ".join([KEY, *(f"{c}:d" for c in ind.PAIR_FEATURES)]),
    f"""SELECT symbol, dt, rsi, macd * 1e4 AS macd, (macd - macd_signal) * 1e4 AS macd_hist, pct_b AS bb_pct_b, bandwidth AS bb_bandwidth, atr_14 * 1e4 AS atr_pips, stoch_k, stoch_d, cci, will_r AS willr,
      CASE WHEN before IS NOT NULL THEN CASE WHEN before > 0 THEN ln(c / before) ELSE 0 END END AS log_ret, CASE WHEN before IS NOT NULL THEN tk END AS tick_vel, CASE WHEN before IS NOT NULL THEN sp END AS spread_pip,
      CASE WHEN before IS NOT NULL THEN (h - l) * 1e4 END AS range_pips, CASE WHEN before IS NOT NULL THEN CASE WHEN h - l > 1e-10 THEN abs(c - o) / (h - l) ELSE 0 END END AS body_ratio, CASE WHEN before IS NOT NULL THEN coalesce(mom5, 0) END AS mom5
    FROM {PIPPED} """
    + " ".join(f"JOIN ({SQL[n]}) USING (symbol, dt)" for n in ("rsi", "macd", "macd_signal", "bollinger", "atr_14", "stochastic", "cci", "williams_r", "mom5")),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.pair_features_16(hourly(spark, d), pip_size(F.col("symbol.name")))


@query(
    "signal_features_7",
    " ".join([KEY, *(f"{c}:d" for c in ind.SIGNAL_FEATURES)]),
    f"""SELECT symbol, dt, CASE WHEN before IS NOT NULL THEN CASE WHEN before > 1e-10 THEN ln(c / before) ELSE 0 END END AS log_ret, rsi AS rsi_14, macd - macd_signal AS macd_hist, bandwidth AS bb_bandwidth, atr_14, cci AS cci_20,
      ret - avg(ret) OVER (PARTITION BY dt) AS laplacian_residual
    FROM {PIPPED} JOIN (SELECT symbol, dt, ret FROM rets) USING (symbol, dt) """
    + " ".join(f"JOIN ({SQL[n]}) USING (symbol, dt)" for n in ("rsi", "macd", "macd_signal", "bollinger", "atr_14", "cci")),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """The residual is a return's distance from the bar's mean return, the residual of a graph whose edges all weigh the same."""
    b = returns(spark, d)
    b = b.withColumn("__residual", F.col("ret") - F.avg("ret").over(Window.partitionBy("dt")))
    return ind.signal_features_7(b, pip_size(F.col("symbol.name"), 1.0), F.col("__residual"))


@query("microstructure_4", f"{KEY} ofi:d velocity_pct:d", f"SELECT symbol, dt, tk * sign(coalesce({ln('c', LAG)}, 0)) AS ofi, 100 * coalesce((c - {LAG}) / nullif({LAG} + 1e-10, 0), 0) AS velocity_pct FROM bars")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.microstructure_4(hourly(spark, d)).withColumn("velocity_pct", 100 * F.col("price_velocity"))


@query("rolling_vol_24", f"{KEY} vol_24:d", f"SELECT symbol, dt, stddev_pop(ret) OVER {over(23)} AS vol_24 FROM rets")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.rolling_vol_24(hourly(spark, d))


@query("regime_signal", f"{KEY} regime_signal:d", f"SELECT symbol, dt, least(greatest(coalesce(r / nullif(abs(a), 0), 0), -5), 5) AS regime_signal FROM (SELECT symbol, dt, coalesce({ln('c', f'lag(c, 3) OVER {ALL}')}, 0) AS r, avg(tr0) OVER {over(13)} / nullif(abs(c), 0) AS a FROM {TR})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.regime_signal(hourly(spark, d))


@query("trend_regime", f"{KEY} trend_regime:d", f"SELECT symbol, dt, CASE WHEN count(*) OVER {over(11)} < 3 THEN 0 ELSE least(greatest(coalesce(sum(ret) OVER {over(11)} / nullif(avg(abs(ret)) OVER {over(11)} * sqrt(12), 0), 0), -3), 3) / 3 END AS trend_regime FROM rets")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.trend_regime(hourly(spark, d))


SESSION = "CASE WHEN isodow({0}) >= 6 THEN 0 WHEN hour({0}) BETWEEN 2 AND 7 THEN 1 WHEN hour({0}) BETWEEN 8 AND 12 THEN 2 WHEN hour({0}) BETWEEN 17 AND 21 THEN 3 WHEN hour({0}) BETWEEN 13 AND 16 THEN 4 ELSE 0 END"
PHASE = "CASE WHEN hour({0}) < 2 THEN 'sydney' WHEN hour({0}) < 9 THEN 'tokyo' WHEN hour({0}) < 13 THEN 'london' WHEN hour({0}) < 22 THEN 'newyork' ELSE 'pre_tokyo' END"


@query("session_code", f"{KEY} session_code:i", f"SELECT symbol, dt, {SESSION.format('dt')} AS session_code FROM bars")
def _(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d).withColumn("session_code", calendar.session_code(F.col("dt")))


@query("session_phase", f"{KEY} phase:s", f"SELECT symbol, dt, {PHASE.format('dt')} AS phase FROM bars")
def _(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d).withColumn("phase", calendar.session_phase(F.col("dt")))


@query("bridge_gate", f"{KEY} gate:d", f"SELECT symbol, dt, CASE WHEN isodow(dt) >= 6 THEN 0 ELSE CASE {PHASE.format('dt')} WHEN 'pre_tokyo' THEN 0.5 WHEN 'tokyo' THEN 0.6 WHEN 'london' THEN 0.8 WHEN 'sydney' THEN 0.4 ELSE 1.0 END * CASE WHEN tk % 5 >= 4 THEN 0.3 WHEN tk % 5 >= 3 THEN 0.7 ELSE 1.0 END END AS gate FROM bars")
def _(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d).withColumn("gate", calendar.bridge_gate(F.col("dt"), F.col("tk") % 5))


@query("calendar_keys", f"{KEY} hour_of_week:i slot:i quarter:s week:t", "SELECT symbol, dt, (isodow(dt) - 1) * 24 + hour(dt) AS hour_of_week, (isodow(dt) - 1) * 288 + hour(dt) * 12 + minute(dt) // 5 AS slot, year(dt) || 'Q' || quarter(dt) AS quarter, date_trunc('week', dt) AS week FROM bars")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("dt")
    return hourly(spark, d).withColumns({"hour_of_week": calendar.hour_of_week(c), "slot": calendar.slot_id(c), "quarter": calendar.quarter_id(c), "week": calendar.week_start(c)})


SESSIONS = f"(SELECT *, {SESSION.format('dt')} AS s, {PHASE.format('dt')} AS phase, tk % 5 <> 0 AS real FROM rets)"
ISLANDS = f"(SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN s <> lag(s) OVER {ALL} THEN 1 ELSE 0 END AS ch FROM {SESSIONS}))"


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return returns(spark, d).withColumns({"s": calendar.session_code(F.col("dt")), "phase": calendar.session_phase(F.col("dt")), "real": F.col("tk") % 5 != 0})


@query("session_transition", f"{KEY} moved:b", f"SELECT symbol, dt, ch = 1 AS moved FROM {ISLANDS}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.changes(_sessions(spark, d), "s", "moved")


@query("session_progress", f"{KEY} progress:i", f"SELECT symbol, dt, CASE WHEN s IN (2, 3, 4) THEN row_number() OVER (PARTITION BY symbol, island ORDER BY dt) ELSE 0 END AS progress FROM {ISLANDS}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.session_progress(_sessions(spark, d), "s")


OPENING = f"""(SELECT *, greatest(hi - lo, greatest(top, 1e-6) * 1e-6) AS width, s IN (2, 3, 4) AND seen >= 3 AS has FROM (
  SELECT *, max(CASE WHEN real AND n <= 3 THEN h END) OVER run AS hi, min(CASE WHEN real AND n <= 3 THEN l END) OVER run AS lo, max(CASE WHEN real AND n <= 3 THEN c END) OVER run AS top, max(n) OVER run AS seen
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol, island ORDER BY dt) AS bar, sum(real::INT) OVER (PARTITION BY symbol, island ORDER BY dt ROWS UNBOUNDED PRECEDING) AS n FROM {ISLANDS}) WINDOW run AS (PARTITION BY symbol, island)))"""
RANGE = """SELECT symbol, dt, CASE WHEN {0} THEN hi END AS or_high, CASE WHEN {0} THEN lo END AS or_low, CASE WHEN {0} THEN width / greatest(c, 1e-6) ELSE 0 END AS or_width,
  CASE WHEN {0} THEN (c - (hi + lo) / 2) / width ELSE 0 END AS or_breakout, s IN (2, 3, 4) AND bar >= 3 AS or_ready FROM """ + OPENING


@query("opening_range", f"{KEY} or_high:d or_low:d or_width:d or_breakout:d or_ready:b", RANGE.format("has AND n >= 3"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.opening_range(_sessions(spark, d), "s")


@query("opening_range_unsafe", f"{KEY} or_high:d or_low:d or_width:d or_breakout:d or_ready:b", RANGE.format("has"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.opening_range(_sessions(spark, d), "s", safe=False)


CONTEXT = f"""(WITH a AS (SELECT i.*, g.regime_signal, greatest(c, 1e-6) AS cc, {RN} AS rn, row_number() OVER (PARTITION BY symbol, island ORDER BY dt) AS seen FROM {ISLANDS} i JOIN ({SQL['regime_signal']}) g USING (symbol, dt)),
  m AS (SELECT *, coalesce(ln(cc / lag(cc, 3) OVER {ALL}), 0) AS momentum_3, coalesce(ln(cc / lag(cc, 6) OVER {ALL}), 0) AS momentum_6, coalesce(ln(cc / lag(cc, 12) OVER {ALL}), 0) AS momentum_12, ln(cc / lag(cc) OVER {ALL}) AS r, max(CASE WHEN seen <= 3 THEN h END) OVER u AS hi, min(CASE WHEN seen <= 3 THEN l END) OVER u AS lo FROM a WINDOW u AS (PARTITION BY symbol, island ORDER BY dt ROWS UNBOUNDED PRECEDING)),
  v AS (SELECT *, CASE WHEN rn < 3 THEN 0 ELSE sqrt(avg(r * r) OVER {over(5)}) END AS volatility_6, CASE WHEN rn < 3 THEN 0 ELSE sqrt(avg(r * r) OVER {over(11)}) END AS volatility_12, greatest(hi - lo, cc * 1e-6) AS width, avg(tk) OVER {over(12, '1 PRECEDING')} AS tm, stddev_pop(tk) OVER {over(12, '1 PRECEDING')} AS td,
    (abs(momentum_3) > 1e-6)::INT + (abs(momentum_6) > 1e-6)::INT + (abs(momentum_12) > 1e-6)::INT AS moved, (CASE WHEN abs(momentum_3) > 1e-6 THEN sign(momentum_3) ELSE 0 END + CASE WHEN abs(momentum_6) > 1e-6 THEN sign(momentum_6) ELSE 0 END + CASE WHEN abs(momentum_12) > 1e-6 THEN sign(momentum_12) ELSE 0 END)::DOUBLE AS signs FROM m)
  SELECT symbol, dt, (s >= 2)::INT AS trade_session, (s >= 2 AND seen >= 3)::INT AS open_ready, CASE WHEN s >= 2 THEN least(seen / 3.0, 2) ELSE 0 END AS open_progress, width / cc AS opening_range_width, least(greatest((cc - lo) / width, -3), 3) AS range_position, least(greatest((cc - (hi + lo) / 2) / width, -4), 4) AS breakout_signed, momentum_3, momentum_6, momentum_12,
    CASE WHEN volatility_12 > 0 THEN abs(momentum_3) / greatest(volatility_12, 1e-6) ELSE 0 END AS momentum_score, coalesce(abs(signs) / nullif(moved, 0), 0) AS momentum_alignment, volatility_6, volatility_12, CASE WHEN volatility_12 > 0 THEN volatility_6 / greatest(volatility_12, 1e-6) ELSE 0 END AS volatility_ratio, sp / cc / greatest(volatility_6, 1e-6) AS spread_stress,
    CASE WHEN rn < 4 OR td < 1e-6 THEN 0 ELSE coalesce((tk - tm) / nullif(td, 0), 0) END AS tick_shock, regime_signal FROM v)"""
CONTEXT_COLUMNS = "trade_session open_ready open_progress opening_range_width range_position breakout_signed momentum_3 momentum_6 momentum_12 momentum_score momentum_alignment volatility_6 volatility_12 volatility_ratio spread_stress tick_shock regime_signal".split()


def context(spark: SparkSession, d: str) -> DataFrame:
    return ind.scalp_context(ind.regime_signal(hourly(spark, d)).withColumn("session_code", calendar.session_code(F.col("dt"))))


@query("scalp_context_17", " ".join([KEY, *(f"{c}:d" for c in CONTEXT_COLUMNS)]), f"SELECT * FROM {CONTEXT}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return context(spark, d)


SIGNS = f"(SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN g <> lag(g) OVER {ALL} THEN 1 ELSE 0 END AS ch FROM (SELECT *, CASE WHEN abs(ret) <= 0.05 THEN 0 ELSE sign(ret) END AS g FROM rets)))"


@query("residual_streak", f"{KEY} streak:i streak_bonus:d", f"SELECT symbol, dt, streak, CASE WHEN streak >= 3 THEN log2(streak) ELSE 0 END AS streak_bonus FROM (SELECT *, CASE WHEN g = 0 THEN 0 ELSE row_number() OVER (PARTITION BY symbol, island ORDER BY dt) END AS streak FROM {SIGNS})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.residual_streak(returns(spark, d), "ret", 0.05)


@query(
    "regime_memory", f"{KEY} regime_before:d regime_age:d regime_ema:d session_transition:b",
    f"""SELECT symbol, dt, coalesce(lag(s) OVER {ALL}, 2) AS regime_before, ln(row_number() OVER (PARTITION BY symbol, island ORDER BY dt) + CASE WHEN island = 0 AND s = 2 THEN 1 ELSE 0 END) AS regime_age,
      list_reduce(list_prepend(2.0::DOUBLE, list(s::DOUBLE) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING)), lambda a, x: 0.1::DOUBLE * x + (1 - 0.1::DOUBLE) * a) AS regime_ema,
      coalesce(phase <> lag(phase) OVER {ALL}, true) AS session_transition FROM {ISLANDS}""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.regime_memory(_sessions(spark, d), "s", "phase")


@query(
    "vol_percentile", f"{KEY} vol_pct:d",
    f"""WITH r AS (SELECT symbol, dt, abs(ret) AS v, sum((abs(ret) > 0)::INT) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING) AS pn FROM rets)
      SELECT a.symbol, a.dt, CASE WHEN a.pn <= 1 THEN 0.5 WHEN NOT coalesce(a.v > 0, false) THEN 0 ELSE avg(CASE WHEN b.v < a.v THEN 1.0 ELSE 0.0 END) END AS vol_pct
      FROM r a LEFT JOIN r b ON a.symbol = b.symbol AND b.v > 0 AND b.pn <= a.pn AND b.pn > a.pn - 240 GROUP BY a.symbol, a.dt, a.pn, a.v""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.vol_percentile(returns(spark, d).withColumn("v", F.abs("ret")), "v", 240)


@query("horizon_return", f"{KEY} ret_h240:d gap_delta:d", f"SELECT symbol, dt, coalesce({ln('c', f'coalesce(lag(c, 240) OVER {ALL}, first_value(c) OVER {ALL})')}, 0) AS ret_h240, coalesce(sp - lag(sp, 59) OVER {ALL}, 0) AS gap_delta FROM bars")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.gap_delta(ind.horizon_return(hourly(spark, d), 240), "sp", 60)


PASTW = "(PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING)"


@query(
    "weekend_carry", f"{KEY} weekend_regime:i weekend_shift:i",
    f"""WITH m AS (SELECT *, (isodow(dt) = 6 AND hour(dt) * 60 + minute(dt) < 360) AS opens, (isodow(dt) = 7 AND hour(dt) * 60 + minute(dt) >= 1080) AS closes FROM (SELECT symbol, dt, tk % 5 AS regime FROM bars)),
      o AS (SELECT *, coalesce(last_value(CASE WHEN opens THEN regime END IGNORE NULLS) OVER {PASTW}, 1) AS opened, closes AND row_number() OVER (PARTITION BY symbol, CASE WHEN closes THEN dt::DATE END, closes ORDER BY dt) = 1 AS first FROM m),
      l AS (SELECT *, last_value(CASE WHEN first THEN regime END IGNORE NULLS) OVER {PASTW} AS r, last_value(CASE WHEN first THEN regime - opened END IGNORE NULLS) OVER {PASTW} AS s FROM o)
      SELECT symbol, dt, coalesce(r, 1) AS weekend_regime, coalesce(s, 0) AS weekend_shift FROM l""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Bars are hourly, so a weekend's start and end are its first and last six hours."""
    return ind.weekend_carry(hourly(spark, d).withColumn("regime", F.col("tk") % 5), "regime", 360)


@query("atr_ratio", f"{KEY} atr_ratio:d", f"SELECT symbol, dt, a / avg(a) OVER {over(59)} AS atr_ratio FROM (SELECT symbol, dt, CASE WHEN rn >= 15 THEN avg(tr) OVER {over(13)} END AS a FROM {TR})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.atr_ratio(hourly(spark, d))


@query("cooldown_mask", f"{KEY} locked:b cooldown_left:i", f"SELECT symbol, dt, coalesce(greatest(6 - since, 0), 0) > 0 AS locked, coalesce(greatest(6 - since, 0), 0) AS cooldown_left FROM (SELECT symbol, dt, rn - last_value(CASE WHEN ret < -1.5 THEN rn END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM (SELECT *, {RN} AS rn FROM rets))")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.cooldown_mask(returns(spark, d).withColumn("stop", F.col("ret") < -1.5), "stop", 5)


@query("sequence_window", f"{KEY} seq:a", f"SELECT symbol, dt, list_concat(list_resize([]::DOUBLE[], 8 - len(w), 0.0::DOUBLE), w) AS seq FROM (SELECT symbol, dt, list(c) OVER {over(7)} AS w FROM bars)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.sequence_window(hourly(spark, d), "c", 8)


@query("drawdown", f"{KEY} peak:d drawdown:d", f"SELECT symbol, dt, max(c) OVER {PASTW} AS peak, (max(c) OVER {PASTW} - c) / max(c) OVER {PASTW} AS drawdown FROM bars")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.drawdown(hourly(spark, d), "c")


CURVE = f"(SELECT dt, r AS ret, turnover, exp(sum(ln(1 + r)) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING)) AS equity FROM (SELECT dt, sum(w * ret) - sum(turn) * 0.001 AS r, sum(turn) AS turnover FROM (SELECT *, abs(w - coalesce(lag(w) OVER {ALL}, 0)) AS turn FROM (SELECT symbol, dt, ret, CASE WHEN tk % 2 = 0 THEN 0.02 ELSE -0.01 END AS w FROM rets)) GROUP BY 1))"


def held(spark: SparkSession, d: str) -> DataFrame:
    return returns(spark, d).select("symbol", "dt", F.when(F.col("tk") % 2 == 0, 0.02).otherwise(-0.01).alias("w"), "ret")


def curve(spark: SparkSession, d: str) -> DataFrame:
    return ind.equity_curve(held(spark, d), 0.001)


@query("equity_curve", "dt:t ret:d turnover:d equity:d", f"SELECT * FROM {CURVE}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return curve(spark, d)


HELD = f"(SELECT symbol, dt, ret, coalesce(last_value(CASE WHEN i % 4 = 0 THEN w END IGNORE NULLS) OVER {PASTW}, 0) AS w FROM (SELECT symbol, dt, ret, CASE WHEN tk % 2 = 0 THEN 0.02 ELSE -0.01 END AS w, dense_rank() OVER (ORDER BY dt) - 1 AS i FROM rets))"


@query("equity_curve_rebalanced", "dt:t ret:d turnover:d equity:d", f"SELECT dt, r AS ret, turnover, exp(sum(ln(1 + r)) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING)) AS equity FROM (SELECT dt, sum(w * ret) - sum(turn) * 0.001 AS r, sum(turn) AS turnover FROM (SELECT *, abs(w - coalesce(lag(w) OVER {ALL}, 0)) AS turn FROM {HELD}) GROUP BY 1)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ind.equity_curve(held(spark, d), 0.001, every=4)
