"""Queries of the cross-asset graph, market aggregates and price profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import calendar
from barloom.functions.numeric import liquidity_stress, pip_size
from barloom.operators import graph, matrix, profile
from barloom.operators import indicators as ind
from barloom.operators.carry import in_blocks
from barloom.plans.indicator_queries import ALL, PHASE, RN, SESSION, TR, over
from barloom.plans.indicator_queries import PASTW as PAST
from barloom.plans.registry import SQL, hourly, query, returns

PAIR = "(PARTITION BY a, b ORDER BY dt ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
PAIRS = "(SELECT x.dt, x.symbol AS a, y.symbol AS b, x.ret AS x, y.ret AS y FROM rets x JOIN rets y ON x.dt = y.dt AND x.symbol < y.symbol)"
CORR = f"(SELECT dt, a, b, CASE WHEN n >= 10 THEN 0.85 * least(greatest(cv / (greatest(sx, 1e-10) * greatest(sy, 1e-10)), -1), 1) END AS corr FROM (SELECT dt, a, b, count(*) OVER {PAIR} AS n, covar_pop(x, y) OVER {PAIR} AS cv, stddev_pop(x) OVER {PAIR} AS sx, stddev_pop(y) OVER {PAIR} AS sy FROM {PAIRS}))"
DIST = f"(SELECT *, sqrt(greatest(2 * (1 - corr), 1e-10)) AS dist FROM {CORR} WHERE corr IS NOT NULL)"
ADJ = f"(SELECT e.*, exp(-dist * dist / (2 * sigma * sigma)) AS adj FROM {DIST} e JOIN (SELECT dt, CASE WHEN quantile_cont(dist, 0.5) > 1e-10 THEN quantile_cont(dist, 0.5) WHEN avg(dist) > 1e-10 THEN avg(dist) ELSE 1 END AS sigma FROM {DIST} GROUP BY 1) s ON e.dt = s.dt)"
BOTH = "(SELECT dt, a AS symbol, b AS other, {0} FROM {1} UNION ALL SELECT dt, b, a, {0} FROM {1})"
NODES = f"(SELECT r.dt, r.symbol, degree, coalesce(r.ret - pull / nullif(degree, 0), 0) AS residual FROM (SELECT e.dt, e.symbol, sum(adj) AS degree, sum(adj * q.ret) AS pull FROM {BOTH.format('adj', ADJ)} e JOIN rets q ON q.dt = e.dt AND q.symbol = e.other GROUP BY 1, 2) n JOIN rets r ON r.dt = n.dt AND r.symbol = n.symbol)"


def _rets(spark: SparkSession, d: str) -> DataFrame:
    return returns(spark, d).select("symbol", "dt", "ret")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.gaussian_adjacency(graph.rolling_corr(_rets(spark, d)))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_residual(_edges(spark, d), _rets(spark, d))


@query("rolling_corr", "dt:t a:s b:s corr:d", f"SELECT * FROM {CORR}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.rolling_corr(_rets(spark, d))


@query("mantegna_distance", "dt:t a:s b:s dist:d", f"SELECT * FROM {DIST}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.rolling_corr(_rets(spark, d)).where("corr is not null").withColumn("dist", graph.mantegna_distance(F.col("corr")))


@query("gaussian_adjacency", "dt:t a:s b:s adj:d", f"SELECT * FROM {ADJ}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query("node_residual", "dt:t symbol:s degree:d residual:d", f"SELECT * FROM {NODES}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d)


@query("laplacian_spectrum", "dt:t gap:d beta0:i beta1:i h1:d trace:d")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return graph.held_spectrum(e.select("dt").distinct(), graph.laplacian_spectrum(e))


def _regimes(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    held = graph.smoothed_h1(graph.held_spectrum(e.select("dt").distinct(), graph.laplacian_spectrum(e)))
    return held.withColumn("regime", graph.regime_class(F.col("beta0"), F.col("beta1"), F.col("h1_ema"), 5))


@query("regime_class", "dt:t h1_ema:d regime:s")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _regimes(spark, d)


@query("graph_residual_features", "dt:t res_mean:d res_std:d res_max:d corr_abs:d n_edges:i", f"SELECT * FROM (SELECT dt, avg(residual) AS res_mean, stddev_pop(residual) AS res_std, max(abs(residual)) AS res_max FROM {NODES} GROUP BY 1) JOIN (SELECT dt, avg(abs(corr)) AS corr_abs, count(*) AS n_edges FROM {ADJ} GROUP BY 1) USING (dt)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_features(_edges(spark, d), _nodes(spark, d))


@query("graph_features_8", "dt:t res_mean:d res_std:d res_max:d gap:d beta0:i beta1:i corr_abs:d trace:d")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_features(_edges(spark, d), _nodes(spark, d)).join(_regimes(spark, d), "dt")


STATIC = f"(SELECT a, b, count(*) AS n, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS corr FROM {PAIRS} GROUP BY 1, 2 HAVING count(*) >= 16)"


@query("static_graph", "a:s b:s n:i corr:d", f"SELECT * FROM {STATIC}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.static_graph(_rets(spark, d))


CLASS = "CASE WHEN symbol IN ('view', 'click') THEN 'browse' ELSE 'act' END"


EDGE_DIST = f"(SELECT dt, a, b, sqrt(greatest(2 * (1 - coalesce(corr, 0)), 1e-8)) AS dist FROM {CORR})"


@query("typed_edges", "dt:t kind:s src:s dst:s weight:d", f"""
  WITH p AS (SELECT d.*, sigma FROM {EDGE_DIST} d JOIN (SELECT dt, greatest(quantile_cont(dist, 0.5), 1e-4) AS sigma FROM {EDGE_DIST} GROUP BY 1) s ON s.dt = d.dt),
  o AS (SELECT symbol, dt, tk % 2 = 0 AND {SESSION.format('dt')} <> 0 AS open FROM bars), m AS (SELECT DISTINCT symbol, {CLASS} AS class FROM bars),
  j AS (SELECT p.*, x.class = y.class AS alike, u.open AND v.open AS opened, length(a) >= 6 AND length(b) >= 6 AND list_has_any([substr(a, 1, 3), substr(a, 4, 3)], [substr(b, 1, 3), substr(b, 4, 3)]) AS money
    FROM p JOIN m x ON x.symbol = a JOIN m y ON y.symbol = b JOIN o u ON u.symbol = a AND u.dt = p.dt JOIN o v ON v.symbol = b AND v.dt = p.dt),
  w AS (SELECT dt, a, b, 'rolling_corr' AS kind, exp(-dist * dist / (2 * sigma * sigma)) AS w FROM j UNION ALL SELECT dt, a, b, 'fundamental', CASE WHEN alike THEN 1.0 WHEN money THEN 0.8 ELSE 0.0 END FROM j UNION ALL SELECT dt, a, b, 'session', CASE WHEN opened THEN 1.0 ELSE 0.0 END FROM j),
  f AS (SELECT dt, kind, a AS src, b AS dst, w FROM w WHERE w > 0 UNION ALL SELECT dt, kind, b, a, w FROM w WHERE w > 0)
  SELECT dt, kind, src, dst, w / sum(w) OVER (PARTITION BY dt, kind, src) AS weight FROM f""")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = returns(spark, d)
    members = r.select("symbol", F.when(F.col("symbol").isin("view", "click"), "browse").otherwise("act").alias("class")).distinct()
    opened = r.select("symbol", "dt", ((F.col("tk") % 2 == 0) & (calendar.session_code(F.col("dt")) != 0)).alias("open"))
    return graph.typed_edges(graph.rolling_corr(r.select("symbol", "dt", "ret")), members, opened)


TRUE_RETS = "(SELECT symbol, dt, ret FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS rn FROM rets) WHERE rn > 1)"
NEAR = "(PARTITION BY a, b ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
LAGGARD = f"""(WITH t AS {TRUE_RETS},
  o AS (SELECT dt, symbol, v6 / greatest(v12, 1e-6) AS ratio, m3 / greatest(v12 * sqrt(3), 1e-6) AS momentum FROM (SELECT dt, symbol, CASE WHEN count(*) OVER {over(5)} > 1 THEN sqrt(avg(ret * ret) OVER {over(5)}) ELSE 0 END AS v6, CASE WHEN count(*) OVER {over(11)} > 1 THEN sqrt(avg(ret * ret) OVER {over(11)}) ELSE 0 END AS v12, sum(ret) OVER {over(2)} AS m3 FROM t)),
  e AS (SELECT dt, a, b, 0.85 * CASE WHEN sx < 1e-6 OR sy < 1e-6 OR n < 6 THEN 0 ELSE cv / (sx * sy) END AS corr FROM (SELECT dt, a, b, count(*) OVER {NEAR} AS n, covar_pop(x, y) OVER {NEAR} AS cv, stddev_pop(x) OVER {NEAR} AS sx, stddev_pop(y) OVER {NEAR} AS sy FROM (SELECT x.dt, x.symbol AS a, y.symbol AS b, x.ret AS x, y.ret AS y FROM t x JOIN t y ON x.dt = y.dt AND x.symbol < y.symbol))),
  s AS (SELECT u.dt, u.symbol, sum(abs(corr)) AS degree, sum(abs(corr) * q.ratio) AS vol, sum(corr * q.momentum) AS mom, count(*) AS others FROM {BOTH.format('corr', 'e')} u JOIN o q ON q.dt = u.dt AND q.symbol = u.other GROUP BY 1, 2),
  f AS (SELECT o.dt, o.symbol, ratio, momentum, mom / greatest(degree, 1e-6) AS nb_momentum, vol / greatest(degree, 1e-6) AS nb_volatility, degree / others AS strength FROM o JOIN s ON o.dt = s.dt AND o.symbol = s.symbol)
  SELECT dt, symbol, nb_momentum, momentum - nb_momentum AS momentum_residual, nb_volatility, nb_volatility - ratio AS vol_laggard, greatest(nb_volatility - ratio, 0) * least(abs(nb_momentum), 3) AS laggard_score, strength FROM f)"""


def true_returns(spark: SparkSession, d: str) -> DataFrame:
    """Returns but a symbol's first bar, which has none."""
    return returns(spark, d).withColumn("__rn", F.row_number().over(ind.by_time())).where("__rn > 1").select("symbol", "dt", "ret")


@query("laggard_features_6", "dt:t symbol:s nb_momentum:d momentum_residual:d nb_volatility:d vol_laggard:d laggard_score:d strength:d", f"SELECT * FROM {LAGGARD}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.laggard_features(true_returns(spark, d))


LOCAL = f"""(SELECT l.*, coalesce(n.residual, 0) AS residual, {SESSION.format('l.dt')} AS session_code FROM (SELECT symbol, dt,
  coalesce(ln(nullif(c, 0) / nullif(coalesce(lag(c) OVER w, c), 0)), 0) AS ret_1, coalesce(ln(nullif(c, 0) / nullif(coalesce(lag(c, 3) OVER w, first_value(c) OVER w), 0)), 0) AS ret_3, coalesce(ln(nullif(c, 0) / nullif(coalesce(lag(c, 6) OVER w, first_value(c) OVER w), 0)), 0) AS ret_6,
  CASE WHEN rn <= 2 THEN h - l ELSE avg(tr) OVER {over(23)} END / nullif(abs(c), 0) AS atr_norm, (h - l) / nullif(abs(c), 0) AS range_norm, CASE WHEN h - l < 1e-10 THEN 0 ELSE abs(c - o) / (h - l) END AS body_ratio,
  CASE WHEN rn <= 2 THEN 0 ELSE coalesce((sp - avg(sp) OVER {over(64, '1 PRECEDING')}) / sqrt(var_pop(sp) OVER {over(64, '1 PRECEDING')} + 1e-8), 0) END AS spread_z, CASE WHEN rn <= 2 THEN 0 ELSE coalesce((tk - avg(tk) OVER {over(64, '1 PRECEDING')}) / sqrt(var_pop(tk) OVER {over(64, '1 PRECEDING')} + 1e-8), 0) END AS tick_z,
  sp / nullif(c, 0) + 1 / sqrt(tk + 1) AS stress FROM {TR} WINDOW w AS (PARTITION BY symbol ORDER BY dt)) l LEFT JOIN {NODES} n ON n.dt = l.dt AND n.symbol = l.symbol)"""
LOCAL_STREAK = f"(SELECT *, CASE WHEN g = 0 THEN 0 ELSE row_number() OVER (PARTITION BY symbol, island ORDER BY dt) END AS streak FROM (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN g <> lag(g) OVER (PARTITION BY symbol ORDER BY dt) THEN 1 ELSE 0 END AS ch FROM (SELECT *, CASE WHEN abs(residual) <= 1e-5 THEN 0 ELSE sign(residual)::INT END AS g FROM {LOCAL}))))"
LOCAL_COLUMNS = "symbol:s dt:t ret_1:d ret_3:d ret_6:d atr_norm:d range_norm:d body_ratio:d spread_z:d tick_z:d stress:d residual:d streak:i session_code:i"


def _local(spark: SparkSession, d: str) -> DataFrame:
    early = F.row_number().over(ind.by_time()) <= 2  # a single earlier row has no deviation
    z = lambda c: F.when(early, 0.0).otherwise(F.col(c))
    b = ind.session_local_features(hourly(spark, d)).withColumns({"spread_z": z("sp_z64"), "tick_z": z("tk_z64"), "session_code": calendar.session_code(F.col("dt")), "atr_norm": F.try_divide(F.col("atr_proxy"), F.abs("c"))})
    b = b.join(_nodes(spark, d).select("symbol", "dt", "residual"), ["symbol", "dt"], "left").withColumn("residual", F.coalesce("residual", F.lit(0.0)))
    return ind.residual_streak(b, "residual", 1e-5)


@query("local_features_12", LOCAL_COLUMNS, f"SELECT * FROM {LOCAL_STREAK}")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The local features without the spectral regime, which SQL can't express."""
    return _local(spark, d)


@query("local_features_13", LOCAL_COLUMNS + " regime:d")
def _(spark: SparkSession, d: str) -> DataFrame:
    code = F.coalesce(*(F.when(F.col("regime") == n, F.lit(float(i))) for i, n in enumerate(("LOW_VOL", "NORMAL", "TRANSITIONAL", "HIGH_STRESS", "FRAGMENTED"))), F.lit(1.0))
    return _local(spark, d).join(_regimes(spark, d).select("dt", "regime"), "dt", "left").withColumn("regime", code)


@query("node_features_14", "symbol:s dt:t o:d h:d l:d c:d sp:d tk:i ret_1:d ret_3:d atr_norm:d range_norm:d lap_residual:d regime_signal:d session_code:i session_transition:b", f"SELECT b.symbol, b.dt, b.o, b.h, b.l, b.c, b.sp, b.tk, r.ret_1, r.ret_3, a.atr_norm, (h - l) / nullif(abs(c), 0) AS range_norm, coalesce(n.residual, 0) AS lap_residual, g.regime_signal, {SESSION.format('b.dt')} AS session_code, m.moved AS session_transition FROM bars b JOIN ({SQL['log_ret']}) r USING (symbol, dt) JOIN ({SQL['atr_norm']}) a USING (symbol, dt) JOIN ({SQL['regime_signal']}) g USING (symbol, dt) JOIN ({SQL['session_transition']}) m USING (symbol, dt) LEFT JOIN {NODES} n ON n.dt = b.dt AND n.symbol = b.symbol")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = ind.shape(ind.regime_signal(ind.log_ret(hourly(spark, d)))).withColumn("session_code", calendar.session_code(F.col("dt")))
    b = ind.changes(b, "session_code", "session_transition").join(_nodes(spark, d).select("symbol", "dt", "residual"), ["symbol", "dt"], "left")
    return b.withColumn("lap_residual", F.coalesce("residual", F.lit(0.0)))


@query("bucket_stats", "dt:t bucket:s trend:d dispersion:d stress:d", f"SELECT dt, {CLASS} AS bucket, avg(ret) AS trend, stddev_pop(ret) AS dispersion, avg(sp / nullif(c, 0) + 1 / sqrt(tk + 1)) AS stress FROM rets GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = returns(spark, d).withColumns({"real": F.lit(True), "stress": liquidity_stress(F.col("sp"), F.col("c"), F.col("tk"))})
    members = r.select("symbol", F.when(F.col("symbol").isin("view", "click"), "browse").otherwise("act").alias("bucket")).distinct()
    return graph.bucket_stats(r, members)


@query("global_regime_stress", "dt:t stress:d regime:i", f"WITH v AS (SELECT dt, CASE WHEN tk % 5 <> 0 AND lag(tk % 5 <> 0, 1, true) OVER {ALL} THEN abs(ret) END AS x FROM rets), p AS (SELECT dt, quantile_cont(x, 0.5) AS stress FROM v GROUP BY 1), q AS (SELECT quantile_cont(stress, 0.5) AS a, quantile_cont(stress, 0.75) AS b, quantile_cont(stress, 0.9) AS c FROM p) SELECT dt, stress, CASE WHEN stress >= c THEN 4 WHEN stress >= b THEN 3 WHEN stress >= a THEN 2 ELSE 1 END AS regime FROM p, q")
def _(spark: SparkSession, d: str) -> DataFrame:
    real = F.col("tk") % 5 != 0
    both = in_blocks(returns(spark, d), 1, lambda x: x.withColumn("ok", real & F.coalesce(F.lag(real).over(ind.by_time()), F.lit(True))))
    return graph.global_regime_stress(both.select("dt", F.when(F.col("ok"), F.col("ret")).alias("ret")))


@query("basket_index", "dt:t basket:d", "SELECT dt, sum(w * ret) / sum(abs(w)) AS basket FROM (SELECT dt, ret, CASE symbol WHEN 'view' THEN 0.5 WHEN 'click' THEN -0.3 WHEN 'purchase' THEN 0.2 END AS w FROM rets) WHERE w IS NOT NULL GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = F.when(F.col("symbol") == "view", 0.5).when(F.col("symbol") == "click", -0.3).when(F.col("symbol") == "purchase", 0.2)
    r = _rets(spark, d)
    return graph.basket_index(r, r.select("symbol").distinct().withColumn("w", w).where("w is not null"))


@query("net_score", "dt:t net:d", f"SELECT dt, (count(*) FILTER (residual > 1e-4) - count(*) FILTER (residual < -1e-4)) / count(*) AS net FROM {NODES} GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.net_score(_nodes(spark, d))


@query("agreement_ratio", "dt:t agreement:d", f"WITH n AS (SELECT n.*, (tk % 10) / 10.0::DOUBLE AS conf FROM {NODES} n JOIN bars b ON b.dt = n.dt AND b.symbol = n.symbol), s AS (SELECT dt, count(*) FILTER (residual > 1e-4) AS up, count(*) FILTER (residual < -1e-4) AS down, count(*) FILTER (conf >= 0.2) AS n, count(*) FILTER (conf >= 0.2 AND residual > 1e-4) AS wu, count(*) FILTER (conf >= 0.2 AND residual < -1e-4) AS wd FROM n GROUP BY 1) SELECT dt, coalesce(CASE WHEN up > down THEN wu WHEN up < down THEN wd ELSE 0 END / nullif(n, 0), 0) AS agreement FROM s")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d).join(hourly(spark, d).select("symbol", "dt", (F.col("tk") % 10 / 10).alias("confidence")), ["symbol", "dt"])
    return graph.agreement_ratio(n, 0.2)


@query("region_influence", "dt:t target:s pull:d", "SELECT dt, target, avg(ret) AS pull FROM rets JOIN (SELECT DISTINCT x.symbol AS source, y.symbol AS target FROM bars x, bars y WHERE x.symbol < y.symbol) ON source = symbol GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = _rets(spark, d)
    s = r.select("symbol").distinct()
    influence = s.select(F.col("symbol").alias("source")).join(F.broadcast(s.select(F.col("symbol").alias("target"))), F.col("source") < F.col("target"))
    return graph.region_influence(r, influence)


@query("top_mispricings", "dt:t symbol:s residual:d side:s", f"SELECT dt, symbol, residual, CASE WHEN residual < -1e-4 THEN 'LONG' WHEN residual > 1e-4 THEN 'SHORT' ELSE 'FLAT' END AS side FROM {NODES} ORDER BY abs(residual) DESC, dt, symbol LIMIT 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("residual")
    n = _nodes(spark, d).withColumn("side", F.when(r < -1e-4, "LONG").when(r > 1e-4, "SHORT").otherwise("FLAT"))
    return n.orderBy(F.abs("residual").desc(), "dt", "symbol").limit(10)


LEAD, CROSSES, BASKET = "purchase", ["view", "click"], {"view": 0.5, "click": -0.3, "signup": 0.2}
PHASE_CODES = ["sydney", "tokyo", "london", "newyork", "pre_tokyo"]
PHASE_CODE = f"list_position({PHASE_CODES!r}, {PHASE.format('dt')}) - 1"
STATE = f"(SELECT dt, count(*) AS beta0, sum(tk) % 4 AS beta1, max(sp) AS h1, avg(sp) AS gap, sum(tk) % 5 AS regime FROM bars GROUP BY 1)"


def _state(spark: SparkSession, d: str) -> DataFrame:
    """A state of each bar: any numbers will do for the columns that come from a spectrum, here counts and spreads."""
    return hourly(spark, d).groupBy("dt").agg(F.count("*").alias("beta0"), (F.sum("tk") % 4).alias("beta1"), F.max("sp").alias("h1"), F.avg("sp").alias("gap"), (F.sum("tk") % 5).cast("int").alias("regime"))


BRIDGE = f"""
  WITH l AS (SELECT r.symbol, r.dt, c, sp, tk, abs(ret) AS v, beta0, beta1, h1, gap, regime, {PHASE_CODE.replace('dt', 'r.dt')} AS phase FROM rets r JOIN {STATE} s ON s.dt = r.dt WHERE symbol = '{LEAD}'),
  a AS (SELECT *, {RN} AS rn, sum((v > 0)::INT) OVER {PAST} AS pn, isodow(dt) = 6 AND hour(dt) * 60 + minute(dt) < 5 AS opens, isodow(dt) = 7 AND hour(dt) * 60 + minute(dt) >= 1435 AS closes,
    ln(c / coalesce(lag(c, 24) OVER {ALL}, first_value(c) OVER {ALL})) AS risk, coalesce(gap - lag(gap, 59) OVER {ALL}, 0) AS gd, CASE WHEN {RN} <= 2 THEN NULL ELSE (tk - avg(tk) OVER {over(60, '1 PRECEDING')}) / (stddev_pop(tk) OVER {over(60, '1 PRECEDING')} + 1e-10) END AS tz,
    CASE WHEN {RN} <= 2 THEN NULL ELSE (sp - avg(sp) OVER {over(60, '1 PRECEDING')}) / (stddev_pop(sp) OVER {over(60, '1 PRECEDING')} + 1e-10) END AS sz, coalesce(lag(regime) OVER {ALL}, 2) AS prev, coalesce(phase <> lag(phase) OVER {ALL}, true)::INT AS moved,
    list_reduce(list_prepend(2.0::DOUBLE, list(regime::DOUBLE) OVER {PAST}), lambda u, x: 0.1::DOUBLE * x + (1 - 0.1::DOUBLE) * u) AS ema, CASE WHEN regime <> lag(regime) OVER {ALL} THEN 1 ELSE 0 END AS ch FROM l),
  i AS (SELECT *, sum(ch) OVER {PAST} AS island FROM a),
  k AS (SELECT *, ln(row_number() OVER (PARTITION BY island ORDER BY dt) + CASE WHEN island = 0 AND regime = 2 THEN 1 ELSE 0 END) AS age FROM i),
  p AS (SELECT x.dt, CASE WHEN x.pn <= 1 THEN 0.5 WHEN NOT x.v > 0 THEN 0 ELSE avg(CASE WHEN y.v < x.v THEN 1.0 ELSE 0.0 END) END AS pct FROM a x LEFT JOIN a y ON y.v > 0 AND y.pn <= x.pn AND y.pn > x.pn - 240 GROUP BY x.dt, x.pn, x.v),
  z AS (SELECT *, CASE WHEN {RN} <= 2 THEN NULL ELSE (sp - avg(sp) OVER {over(60, '1 PRECEDING')}) / (stddev_pop(sp) OVER {over(60, '1 PRECEDING')} + 1e-10) END AS gz FROM rets WHERE symbol <> '{LEAD}'),
  g AS (SELECT dt, avg(ret) AS summary, sum(CASE symbol WHEN 'view' THEN 0.5 WHEN 'click' THEN -0.3 WHEN 'signup' THEN 0.2 END * ret) / sum(CASE symbol WHEN 'view' THEN 0.5 WHEN 'click' THEN 0.3 WHEN 'signup' THEN 0.2 END) AS dxy, avg(gz) AS spread, avg(ret) FILTER (symbol IN ('view', 'click')) AS crosses FROM z GROUP BY 1),
  t AS (SELECT *, CASE WHEN isodow(dt) >= 6 THEN 0 ELSE CASE {PHASE.format('dt')} WHEN 'pre_tokyo' THEN 0.5 WHEN 'tokyo' THEN 0.6 WHEN 'london' THEN 0.8 WHEN 'sydney' THEN 0.4 ELSE 1.0 END * CASE WHEN regime >= 4 THEN 0.3 WHEN regime >= 3 THEN 0.7 ELSE 1.0 END END AS gate FROM k)
  SELECT t.dt, 1 * gate AS btc_weekend_regime, 0 * gate AS btc_weekend_regime_shift, pct * gate AS btc_vol_percentile, risk * gate AS btc_risk_sentiment, gd * gate AS btc_spectral_gap_delta, tz * gate AS btc_tick_velocity_z, sz * gate AS btc_spread_z, h1 * gate AS btc_h1_lifespan, gate AS btc_bridge_gate,
    phase AS fx_session_phase, coalesce(summary, 0) AS fx_regime_summary, coalesce(dxy, 0) AS fx_dxy_proxy, coalesce(spread, 0) AS fx_avg_spread_z, coalesce(crosses, 0) AS fx_jpy_cross_mean_ret, gap AS fx_spectral_gap,
    beta0 AS graph_betti_0, beta1 AS graph_betti_1, h1 AS graph_max_h1_life, gap AS graph_spectral_gap, regime AS graph_regime, prev AS prev_regime, age AS bars_in_regime, moved AS session_transition, ema AS regime_ema FROM t JOIN p ON p.dt = t.dt LEFT JOIN g ON g.dt = t.dt"""


def _bridge(spark: SparkSession, d: str) -> DataFrame:
    r = returns(spark, d)
    lead = r.where(F.col("symbol") == LEAD).select("symbol", "dt", "c", "sp", "tk", F.abs("ret").alias("atr"))
    phase = F.array_position(F.array(*map(F.lit, PHASE_CODES)), calendar.session_phase(F.col("dt"))) - 1
    gate = calendar.bridge_gate(F.col("dt"), F.col("regime"))
    return matrix.cross_bridge(lead, r.where(F.col("symbol") != LEAD).select("symbol", "dt", "ret", "sp"), _state(spark, d), BASKET, CROSSES, phase, gate, horizon=24, history=240)


BRIDGE_COLUMNS = [*matrix.TO_GROUP, "btc_bridge_gate", *matrix.TO_LEAD, *matrix.SHARED]


@query("cross_bridge_features", " ".join(["dt:t", *(f"{c}:d" for c in BRIDGE_COLUMNS)]))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _bridge(spark, d)


#: Columns whose first rows differ by how a deviation of one value is written, and weekends' ends that hourly bars do not reach.
SETTLED = [c for c in BRIDGE_COLUMNS if c not in ("btc_tick_velocity_z", "btc_spread_z", "fx_avg_spread_z", "btc_weekend_regime", "btc_weekend_regime_shift")]


@query("cross_bridge_settled", " ".join(["dt:t", *(f"{c}:d" for c in SETTLED)]), BRIDGE)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _bridge(spark, d)


TRADED, INFORMING = ["purchase", "signup", "view"], ["click", "error"]
WIDE = f"""
  WITH p AS ({SQL['pair_features_16']}), s AS ({SQL['signal_features_7']}), n AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS i FROM (SELECT DISTINCT dt FROM bars)), w AS (SELECT dt FROM n WHERE i >= 120 AND (i - 120) % 15 = 0),
  x AS (SELECT dt, {', '.join(f"max(CASE WHEN symbol = '{t}' THEN {f} END) AS {t}_{f}" for t in TRADED for f in ind.PAIR_FEATURES)} FROM p GROUP BY 1),
  y AS (SELECT dt, {', '.join(f"max(CASE WHEN symbol = '{t}' THEN {f} END) AS {t}_{f}" for t in INFORMING for f in ind.SIGNAL_FEATURES)} FROM s GROUP BY 1),
  l AS (SELECT dt, CASE WHEN lead(c) OVER (ORDER BY dt) > c THEN 1 WHEN lead(c) OVER (ORDER BY dt) <= c THEN 0 END AS label FROM bars WHERE symbol = 'view'),
  g AS (SELECT * FROM ({SQL['graph_residual_features']}))
  SELECT * FROM w LEFT JOIN x USING (dt) LEFT JOIN y USING (dt) LEFT JOIN g USING (dt) LEFT JOIN l USING (dt)"""
WIDE_COLUMNS = [*(f"{t}_{f}" for t in TRADED for f in ind.PAIR_FEATURES), *(f"{t}_{f}" for t in INFORMING for f in ind.SIGNAL_FEATURES)]


@query("feature_matrix_wide", " ".join(["dt:t", *(f"{c}:d" for c in WIDE_COLUMNS), "res_mean:d res_std:d res_max:d corr_abs:d n_edges:i label:i"]), WIDE)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol of the table, 16 or 7 features each; the graph's columns are those that need no spectrum."""
    r = returns(spark, d)
    residual = r.withColumn("__residual", F.col("ret") - F.avg("ret").over(Window.partitionBy("dt")))
    labelled = in_blocks(r.where("symbol = 'view'").withColumn("__t", -F.unix_seconds(F.col("dt").cast("timestamp"))), 1, lambda x: x.withColumn("label", (F.lag("c").over(Window.partitionBy("symbol").orderBy("__t")) > F.col("c")).cast("int")), time="__t")
    return matrix.feature_matrix(
        ind.pair_features_16(r, pip_size(F.col("symbol.name"))), TRADED, ind.signal_features_7(residual, pip_size(F.col("symbol.name"), 1.0), F.col("__residual")), INFORMING,
        graph.graph_features(_edges(spark, d), _nodes(spark, d)), labelled, matrix.sampled_bars(r),
    )


def _profiles(windows: str, bins: int) -> str:
    """Profiles of windows (symbol, dt, k, c, atr, w): each value area grows by a recursion over rows."""
    edge = "CASE WHEN {0} = %d THEN hi ELSE lo + {0} * st END" % bins
    unit = "least(greatest({0}, {1}), 50)"
    return f"""(WITH RECURSIVE x AS (SELECT *, list_min(list_transform(w, lambda v: v.l)) AS lo, list_max(list_transform(w, lambda v: v.h)) AS hi FROM {windows}),
      s AS (SELECT *, (hi - lo) / {bins} AS st FROM x WHERE atr > 1e-6 AND hi - lo >= 1e-8),
      n AS (SELECT * EXCLUDE (w), list_transform(range({bins}), lambda b: len(list_filter(w, lambda v: least(floor((v.l - lo) / st), {bins - 1}) <= b AND b < greatest(least(ceil((v.h - lo) / st), {bins}), 1)))) AS n FROM s),
      t AS (SELECT *, list_sum(n) AS al, list_max(n) AS top, list_position(n, list_max(n)) - 1 AS poc FROM n),
      g AS (SELECT symbol, dt, k, n, al, poc AS i, poc AS j, top::DOUBLE AS has FROM t UNION ALL
        SELECT symbol, dt, k, n, al, CASE WHEN up THEN i ELSE i - 1 END, CASE WHEN up THEN j + 1 ELSE j END, has + CASE WHEN up THEN n[j + 2] ELSE n[i] END
        FROM (SELECT *, i = 0 OR (j < {bins - 1} AND n[j + 2] >= n[i]) AS up FROM g WHERE has < 0.7 * al AND (i > 0 OR j < {bins - 1}))),
      a AS (SELECT symbol, dt, k, min(i) AS i, max(j) AS j FROM g GROUP BY ALL),
      r AS (SELECT symbol, dt, k, ({edge.format('poc')} + {edge.format('(poc + 1)')}) / 2 AS poc, {edge.format('(j + 1)')} AS vah, {edge.format('i')} AS val, lo, hi, top / al AS balance FROM t JOIN a USING (symbol, dt, k))
      SELECT x.symbol, x.dt, x.k, x.c, x.atr, x.w, coalesce(poc, c) AS poc, coalesce(vah, c) AS vah, coalesce(val, c) AS val, coalesce(r.lo, c) AS low, coalesce(r.hi, c) AS high, coalesce(balance, CASE WHEN atr > 1e-6 THEN 1 ELSE 0 END) AS balance,
        CASE WHEN poc IS NULL THEN 0 ELSE {unit.format('(c - poc) / atr', '-50')} END AS dist_poc, CASE WHEN poc IS NULL THEN 0 ELSE {unit.format('(vah - val) / atr', '0')} END AS width, NOT coalesce(atr > 1e-6, false) AS degenerate FROM x LEFT JOIN r USING (symbol, dt, k))"""


ATRS = f"(SELECT b.*, a.atr_series AS atr FROM bars b JOIN ({SQL['atr_series']}) a USING (symbol, dt))"
LAST_48 = f"(SELECT symbol, dt, 48 AS k, c, atr, list({{'h': h, 'l': l, 'c': c}}) OVER {over(47)} AS w FROM {ATRS})"
LOOKBACKS = f"(SELECT symbol, dt, k, c, atr, w[greatest(len(w) - k, 0) + 1:] AS w FROM (SELECT symbol, dt, c, atr, list({{'h': h, 'l': l, 'c': c}}) OVER {over(191)} AS w FROM {ATRS}), (SELECT unnest([24, 48, 96, 192]) AS k))"


@query("tpo_profile", "symbol:s dt:t poc:d vah:d val:d low:d high:d balance:d dist_poc:d width:d degenerate:b", f"SELECT * FROM {_profiles(LAST_48, 24)}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return profile.tpo_profile(ind.atr_series(hourly(spark, d)), "atr_series")


MEMORY = f"""(WITH p AS (SELECT *, 1 / sqrt(len(w)) AS wt FROM {_profiles(LOOKBACKS, 32)}),
  m AS (SELECT symbol, dt, any_value(c) AS c, any_value(atr) AS atr, max(len(w)) AS n, bool_or(degenerate) AS degenerate, arg_max(w, k) AS w, sum(wt * dist_poc) / sum(wt) AS dist, sum(wt * width) / sum(wt) AS width, sum(wt * balance) / sum(wt) AS balance,
    sum(CASE WHEN c < val THEN wt ELSE 0 END) / sum(wt) AS support, sum(CASE WHEN c > vah THEN wt ELSE 0 END) / sum(wt) AS resistance, list(wt ORDER BY k) AS wts, list(poc ORDER BY k) AS pocs, list(vah ORDER BY k) AS vahs, list(val ORDER BY k) AS vals,
    arg_min(dist_poc, k) AS d1, arg_min(width, k) AS w1, arg_min(balance, k) AS b1 FROM p GROUP BY 1, 2),
  z AS (SELECT *, vahs[1] + list_sum(list_transform(range(1, 5), lambda i: wts[i] * (vahs[i] - vahs[1]))) / list_sum(wts) AS mvah, vals[1] + list_sum(list_transform(range(1, 5), lambda i: wts[i] * (vals[i] - vals[1]))) / list_sum(wts) AS mval FROM m),
  o AS (SELECT *, list_avg(list_transform(w[greatest(n - 12, 0) + 1:], lambda v: CASE WHEN v.c >= mval AND v.c <= mvah THEN 1.0 ELSE 0.0 END)) AS inside, list_avg(list_transform(range(1, 4), lambda i: greatest(least(vahs[i], vahs[i + 1]) - greatest(vals[i], vals[i + 1]), 0) / greatest(vahs[i] - vals[i], vahs[i + 1] - vals[i + 1], 1e-8))) AS shared FROM z)
  SELECT symbol, dt, CASE WHEN degenerate THEN 0 WHEN n < 12 THEN d1 ELSE dist END AS tpo_poc_distance_atr, CASE WHEN degenerate THEN 0 WHEN n < 12 THEN w1 ELSE width END AS tpo_value_area_width_atr, CASE WHEN degenerate THEN 0 WHEN n < 12 THEN b1 ELSE balance END AS tpo_balance_score,
    CASE WHEN degenerate OR n < 12 THEN 0 ELSE support END AS tpo_support_score, CASE WHEN degenerate OR n < 12 THEN 0 ELSE resistance END AS tpo_resistance_score, CASE WHEN degenerate OR n < 12 THEN 0 ELSE 1 - inside END AS tpo_rejection_score,
    CASE WHEN degenerate OR n < 12 THEN 0 ELSE least(greatest((pocs[1] - pocs[4]) / atr, -50), 50) END AS tpo_poc_drift_atr, CASE WHEN degenerate THEN 0 WHEN n < 12 THEN 1 ELSE shared END AS tpo_value_area_overlap FROM o)"""


@query("tpo_memory_8", "symbol:s dt:t tpo_poc_distance_atr:d tpo_value_area_width_atr:d tpo_balance_score:d tpo_support_score:d tpo_resistance_score:d tpo_rejection_score:d tpo_poc_drift_atr:d tpo_value_area_overlap:d", f"SELECT * FROM {MEMORY}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return profile.tpo_memory(ind.atr_series(hourly(spark, d)), "atr_series")


@query("tpo_bins", "symbol:s dt:t bin:i n:i", f"WITH w AS (SELECT symbol, dt, min(l) OVER {over(47)} AS lo, max(h) OVER {over(47)} AS hi, list({{'h': h, 'l': l}}) OVER {over(47)} AS x FROM bars), e AS (SELECT symbol, dt, lo, (hi - lo) / 16 AS width, unnest(x) AS x FROM w WHERE hi > lo), b AS (SELECT symbol, dt, unnest(generate_series(least(floor((x.l - lo) / width), 15)::INT, least(floor((x.h - lo) / width), 15)::INT)) AS bin FROM e) SELECT symbol, dt, bin, count(*) AS n FROM b GROUP BY 1, 2, 3")
def _(spark: SparkSession, d: str) -> DataFrame:
    return profile.profile_bins(hourly(spark, d))
