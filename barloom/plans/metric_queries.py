"""Queries of scores, folds, ledgers and portfolios."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators import metrics
from barloom.plans.indicator_queries import CURVE, curve, held
from barloom.plans.registry import ledger, query, scored, table


@query("binary_scores", "n:i log_loss:d brier:d accuracy:d", "SELECT count(*) AS n, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS log_loss, avg((p - y) * (p - y)) AS brier, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM (SELECT *, least(greatest(p, 1e-7), 1 - 1e-7) AS q FROM scored)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.classification(scored(spark, d))


@query("class_scores", "n:i log_loss:d brier:d accuracy:d ece:d", """WITH r AS (SELECT [a, b, 1 - a - b] AS p, y FROM (SELECT 0.1::DOUBLE + p * 0.3 AS a, 0.1::DOUBLE + ((id % 11) / 20.0::DOUBLE) AS b, (id % 3)::INT AS y FROM scored)),
  m AS (SELECT *, list_max(p) AS best, (list_position(p, list_max(p)) - 1 = y)::INT::DOUBLE AS hit FROM r), g AS (SELECT least(floor(best * 10), 9) AS bin, count(*) AS n, sum(hit) AS hit, sum(best) AS best FROM m GROUP BY 1)
  SELECT count(*) AS n, avg(-ln(least(greatest(p[y + 1], 1e-7), 1 - 1e-7))) AS log_loss, avg((power(p[1] - (y = 0)::INT, 2) + power(p[2] - (y = 1)::INT, 2) + power(p[3] - (y = 2)::INT, 2)) / 3) AS brier, avg(hit) AS accuracy, (SELECT sum(abs(hit - best)) / sum(n) FROM g) AS ece FROM m""")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).select((0.1 + F.col("p") * 0.3).alias("a"), (0.1 + F.col("id") % 11 / 20).alias("b"), (F.col("id") % 3).alias("y"))
    return metrics.classification_of(s.withColumn("c", 1 - F.col("a") - F.col("b")), ["a", "b", "c"])


@query("calibration_curve", "bin:i n:i mean_p:d rate:d", "SELECT least(floor(p * 8), 7) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM scored GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calibration_curve(scored(spark, d), 8)


@query("ece", "ece:d", "SELECT sum(n * abs(mean_p - rate)) / sum(n) AS ece FROM (SELECT least(floor(p * 8), 7) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM scored GROUP BY 1)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ece(scored(spark, d), 8)


@query("auc", "symbol:s auc:d", "SELECT symbol, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0) AS auc FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY p, id)::DOUBLE AS r FROM scored) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auc(scored(spark, d), ["symbol"])


@query("auc_average_ties", "symbol:s auc:d", "SELECT symbol, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0) AS auc FROM (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY p) + (count(*) OVER (PARTITION BY symbol, p) - 1) / 2 AS r FROM scored) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auc(scored(spark, d), ["symbol"], ties="average")


@query("regression_metrics", "mae:d mse:d rmse:d r2:d top_accuracy:d", "WITH s AS (SELECT p - 0.5 AS pr, fwd AS y FROM scored WHERE fwd IS NOT NULL), c AS (SELECT quantile_cont(abs(pr), 0.7) AS cut, avg(y) AS m FROM s) SELECT avg(abs(pr - y)) AS mae, avg((pr - y) * (pr - y)) AS mse, sqrt(avg((pr - y) * (pr - y))) AS rmse, 1 - sum((pr - y) * (pr - y)) / sum((y - m) * (y - m)) AS r2, avg(CASE WHEN sign(pr) = sign(y) THEN 1.0 ELSE 0.0 END) FILTER (abs(pr) >= cut) AS top_accuracy FROM s, c")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).where("fwd is not null").withColumn("pr", F.col("p") - 0.5)
    return metrics.regression_metrics(s, "pr", "fwd")


@query("strategy_sharpe", "symbol:s sharpe:d n:i", "SELECT symbol, coalesce(avg(x) * sqrt(252) / nullif(stddev_samp(x), 0), 0) AS sharpe, count(x) AS n FROM (SELECT symbol, (2 * p - 1) * fwd AS x FROM scored) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.strategy_sharpe(scored(spark, d), (2 * F.col("p") - 1) * F.col("fwd"), 252)


STAKES = """(WITH a AS (SELECT *, CASE WHEN p >= 0.58 THEN 1 WHEN p <= 0.42 THEN -1 ELSE 0 END AS s0, (id % 9) / 4.0::DOUBLE AS mom, (id % 13) / 5.0::DOUBLE AS vr, (id % 11 - 5) / 5.0::DOUBLE AS brk, (id % 17 - 8) / 8.0::DOUBLE AS nb, (id % 19) / 10.0::DOUBLE AS lag, id % 5 <> 0 AS sess FROM scored),
  b AS (SELECT *, CASE WHEN sess THEN s0 ELSE 0 END AS s1 FROM a),
  c AS (SELECT *, CASE WHEN s1 <> 0 THEN least(greatest(0.35 + 0.65 * least(greatest(mom / 0.7, 0), 1.5), 0.25), 1.25) ELSE 1 END AS m1, CASE WHEN s1 <> 0 THEN least(1.0, least(greatest(vr / 0.6, 0.25), 1), least(greatest(2.0 / greatest(vr, 1e-6), 0.25), 1)) ELSE 1 END AS m2, CASE WHEN s1 > 0 THEN brk WHEN s1 < 0 THEN -brk ELSE 0 END AS along FROM b),
  d AS (SELECT *, CASE WHEN along > 0 THEN s1 ELSE 0 END AS side FROM c),
  e AS (SELECT *, CASE WHEN side <> 0 THEN least(greatest(0.35 + 0.65 * least(greatest(along / 0.4, 0), 1.5), 0.25), 1.25) ELSE 1 END AS m3 FROM d),
  f AS (SELECT *, least(greatest((1.5 * w - (1 - w)) / 1.5 * 0.25, 0), 0.05) * (m1 + m2 + m3) / 3 * least(greatest(1 + 0.35 * (exp(2 * side * nb) - 1) / (exp(2 * side * nb) + 1), 0.5), 1.5) * least(greatest(0.65 + 0.35 * least(greatest(lag / 0.9, 0), 1), 0.5), 1) AS raw FROM (SELECT *, CASE WHEN side > 0 THEN p ELSE 1 - p END AS w FROM e))
  SELECT id, p, y, fwd, side, CASE WHEN side <> 0 THEN least(greatest(raw * (1 + 0.2 * least(greatest(lag, 0), 1)), 0), 0.05) ELSE 0 END AS stake FROM f)"""


def _staked(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    s = scored(spark, d).withColumns({"mom": i % 9 / 4, "vr": i % 13 / 5, "brk": (i % 11 - 5) / 5, "nb": (i % 17 - 8) / 8, "lag": i % 19 / 10, "sess": i % 5 != 0})
    return metrics.kelly_stakes(s, "p", 0.08, 1.5, session="sess", momentum="mom", momentum_floor=0.7, vol_ratio="vr", vol_floor=0.6, vol_cap=2.0, breakout="brk", breakout_floor=0.4, neighbours="nb", laggard="lag", laggard_floor=0.9, boost=0.2)


@query("kelly_stakes", "id:i side:i stake:d", f"SELECT * FROM {STAKES}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _staked(spark, d)


@query("kelly_eval", "sharpe:d trades:i win_rate:d mean_stake:d hit_rate:d mean_return:d", f"SELECT avg(x) / stddev_pop(x) * sqrt(252 * 78) AS sharpe, count(*) AS trades, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(stake) AS mean_stake, avg(CASE WHEN (p >= 0.5)::INT = y THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(x) AS mean_return FROM (SELECT *, side * fwd * stake AS x FROM {STAKES} WHERE side <> 0 AND fwd IS NOT NULL)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.kelly_eval(_staked(spark, d).where("fwd is not null"), "p", "y", "fwd")


@query("param_grid", "cfg:i entry:d trades:i score:d rank:i", "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, cfg) AS rank FROM (SELECT cfg, entry, count(x) AS trades, coalesce(avg(x) / nullif(stddev_samp(x), 0), 0) - CASE WHEN count(x) < 10 OR count(x) > 0.5 * count(*) THEN 1 ELSE 0 END AS score FROM (SELECT cfg, entry, CASE WHEN p >= entry THEN fwd WHEN p <= 1 - entry THEN -fwd END AS x FROM scored, (SELECT n_nationkey AS cfg, 0.5051 + n_nationkey * 0.019 AS entry FROM nation)) GROUP BY 1, 2)) WHERE rank <= 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    grid = table(spark, d, "nation").select(F.col("n_nationkey").alias("cfg"), (0.5051 + F.col("n_nationkey") * 0.019).alias("entry"))
    return metrics.param_grid(scored(spark, d), grid, "p", "fwd", 5)


FOLDS = "(SELECT symbol AS config, CAST(date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', dt)) // 5 AS BIGINT) AS fold, avg((p - y) * (p - y)) AS loss, avg((2 * p - 1) * fwd) AS score, count(*) AS n FROM scored GROUP BY 1, 2)"


def _folds(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor(F.timestamp_diff("DAY", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("dt")) / 5)
    return scored(spark, d).groupBy(F.col("symbol").alias("config"), day.alias("fold")).agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("loss"), F.avg((2 * F.col("p") - 1) * F.col("fwd")).alias("score"), F.count("*").alias("n"))


@query("fold_summary", "config:s mean:d worst:d dispersion:d n:i accepted:b", f"SELECT config, avg(score) AS mean, min(score) AS worst, stddev_pop(score) AS dispersion, count(*) AS n, avg(score) >= 6 AND min(score) > -2 AS accepted FROM {FOLDS} GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.fold_summary(_folds(spark, d))


@query("pbo_cscv", "pbo:d n_splits:i", f"WITH f AS (SELECT * FROM {FOLDS}), m AS (SELECT r AS mask FROM range(0, 64) t(r) WHERE bit_count(r) = 3), p AS (SELECT mask, config, avg(loss) FILTER ((mask >> fold) & 1 = 1) AS isl, avg(score) FILTER ((mask >> fold) & 1 = 0) AS oos FROM f, m GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY isl, config) AS b, row_number() OVER (PARTITION BY mask ORDER BY oos, config) AS k, count(*) OVER (PARTITION BY mask) AS n FROM p) SELECT avg(CASE WHEN ln((k / (n + 1)) / (1 - k / (n + 1))) < 0 THEN 1.0 ELSE 0.0 END) AS pbo, count(*) AS n_splits FROM r WHERE b = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pbo_cscv(_folds(spark, d))


CDF = "CASE WHEN {0} >= 0 THEN 1 - {1} ELSE {1} END".format("z", "k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))) * exp(-z * z / 2) / sqrt(2 * pi())")


def _ppf(p: str) -> str:
    """The rational form of the inverse normal distribution, for p of .5 or more."""
    return "(SELECT t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308))) FROM (SELECT sqrt(-2 * ln(1 - (%s))) AS t))" % p


MOMENTS = f"""(SELECT config, count(*) AS n, avg(score) AS m, stddev_samp(score) AS s, coalesce(sum(power(score - mu, 3)) / count(*) / power(nullif(stddev_pop(score), 0), 3), NULL) AS sk, sum(power(score - mu, 4)) / count(*) / power(nullif(stddev_pop(score), 0), 4) - 3 AS ku FROM (SELECT *, avg(score) OVER (PARTITION BY config) AS mu FROM {FOLDS}) GROUP BY 1)"""
CHANCE = f"(SELECT config, {CDF} AS chance FROM (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS k FROM {{0}}))"
BEST = f"""(SELECT config, (sharpe - greatest(0, top / sqrt(greatest(mean, 2)))) * sqrt(bars - 1) / sqrt(greatest(1 - 0.25 * sharpe * sharpe, 1e-12)) AS z FROM (SELECT config, max(score) AS sharpe, arg_max(n, score) AS bars, avg(n) AS mean, (1 - 0.5772156649) * {_ppf('1 - 1 / trials')} + 0.5772156649 * {_ppf('1 - 1 / (trials * exp(1))')} AS top
  FROM (SELECT *, count(*) OVER (PARTITION BY config) AS trials FROM {FOLDS}) GROUP BY config, trials))"""


@query("psr_dsr_wfe", "config:s psr:d dsr:d wfe:d", f"""SELECT p.config, p.chance AS psr, d.chance AS dsr, w.wfe FROM {CHANCE.format('(SELECT config, sharpe * sqrt(n - 1) / sqrt(greatest(1 - sk * sharpe + (ku - 1) / 4 * sharpe * sharpe, 1e-12)) AS z FROM (SELECT *, coalesce(m / nullif(s, 0), 0) AS sharpe FROM ' + MOMENTS + '))')} p
  JOIN {CHANCE.format(BEST)} d USING (config) JOIN (SELECT config, round(avg(score) / avg(1 / (1 + greatest(loss, 0))), 4) AS wfe FROM {FOLDS} GROUP BY 1) w USING (config)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    f = _folds(spark, d)
    s = f.groupBy("config").agg(F.avg("score").alias("m"), F.stddev_samp("score").alias("s"), F.skewness("score").alias("sk"), F.kurtosis("score").alias("ku"), F.count("*").alias("n"))
    sharpe = F.coalesce(F.try_divide(F.col("m"), F.col("s")), F.lit(0.0))
    s = s.select("config", metrics.psr(sharpe, F.col("n"), F.col("sk"), F.col("ku"), F.lit(0.0)).alias("psr"))
    return s.join(metrics.dsr(f), "config").join(metrics.wfe(f), "config")


LEDGER = "(SELECT *, size * 0.37 AS cost FROM ledger)"


@query(
    "ledger_metrics", "trades:i winners:i losers:i win_rate:d avg_win:d avg_loss:d ev:d profit_factor:d sharpe:d spread_drag_k:d return_share:d drawdown:d",
    f"""WITH m AS (SELECT count(*) AS trades, count(*) FILTER (pnl > 0) AS winners, count(*) FILTER (pnl <= 0) AS losers, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(pnl) FILTER (pnl > 0) AS avg_win, avg(-pnl) FILTER (pnl <= 0) AS avg_loss,
      sum(pnl) FILTER (pnl > 0) / sum(-pnl) FILTER (pnl <= 0) AS profit_factor, avg(pnl) / (stddev_pop(pnl) + 1e-10) * sqrt(252) AS sharpe, sum(cost) / 1e6 AS spread_drag_k, sum(pnl) / 1e8 AS return_share FROM {LEDGER}),
      e AS (SELECT day, 1e8 + sum(x) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS eq FROM (SELECT day, sum(pnl) AS x FROM ledger GROUP BY 1)), k AS (SELECT eq, greatest(max(eq) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 1e8) AS peak FROM e)
      SELECT m.*, win_rate * avg_win - (1 - win_rate) * avg_loss AS ev, (SELECT max((peak - eq) / peak) FROM k) AS drawdown FROM m""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    trades = ledger(spark, d).withColumn("cost", F.col("size") * 0.37)
    return metrics.ledger_metrics(trades, ["day"], "cost", 1e8).withColumn("spread_drag_k", F.col("spread_drag") / 1e6)


@query("ledger_breakdown", "reason:s tercile:s trades:i pnl_k:d win_rate:d", "WITH q AS (SELECT quantile_cont(size, 1.0::DOUBLE / 3) AS a, quantile_cont(size, 2.0::DOUBLE / 3) AS b FROM ledger) SELECT reason, CASE WHEN size <= a THEN 'low' WHEN size <= b THEN 'mid' ELSE 'high' END AS tercile, count(*) AS trades, sum(pnl) / 1e6 AS pnl_k, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM ledger, q GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ledger_breakdown(ledger(spark, d), "size").withColumn("pnl_k", F.col("pnl") / 1e6)


@query("trade_pnl", "l_orderkey:i l_linenumber:i net:d", "SELECT l_orderkey, l_linenumber, pnl / 977.13 - size * 0.0213 AS net FROM ledger")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ledger(spark, d).withColumn("net", F.col("pnl") / 977.13 - F.col("size") * 0.0213)


@query("confidence_buckets", "lo:d hi:d n:i win_rate:d avg_ret:d", "SELECT lo, hi, count(fwd) AS n, coalesce(avg(CASE WHEN fwd > 0 THEN 1.0 WHEN fwd <= 0 THEN 0.0 END), 0) AS win_rate, coalesce(avg(fwd), 0) AS avg_ret FROM (SELECT n_nationkey * 0.041 AS lo, (n_nationkey + 1) * 0.041 AS hi FROM nation) e LEFT JOIN (SELECT abs(2 * p - 1) AS conf, fwd FROM scored) s ON conf >= lo AND conf < hi GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "nation").select((F.col("n_nationkey") * 0.041).alias("lo"), ((F.col("n_nationkey") + 1) * 0.041).alias("hi"))
    return metrics.confidence_buckets(scored(spark, d).withColumn("conf", F.abs(2 * F.col("p") - 1)), edges, "conf", "fwd")


@query("daily_pnl", "day:t pnl_k:d cumulative_k:d", "SELECT day, sum(pnl) / 1e6 AS pnl_k, sum(sum(pnl)) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) / 1e6 AS cumulative_k FROM ledger GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.daily_pnl(ledger(spark, d), "day").withColumns({"pnl_k": F.col("pnl") / 1e6, "cumulative_k": F.col("cumulative") / 1e6})


WEIGHTS = "(SELECT symbol, dt, ret, CASE WHEN tk % 2 = 0 THEN 0.02 ELSE -0.01 END AS w FROM rets)"


@query("portfolio_stats", "total_return:d sharpe:d sortino:d calmar:d max_drawdown:d hit_rate:d bars:i turnover:d long:d short:d gross:d net:d", f"""
  WITH c AS (SELECT *, (peak - equity) / (peak + 1e-10) AS dd FROM (SELECT *, greatest(max(equity) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING), 1) AS peak FROM {CURVE})),
  e AS (SELECT avg(u) AS long, avg(v) AS short FROM (SELECT sum(greatest(w, 0)) AS u, sum(greatest(-w, 0)) AS v FROM {WEIGHTS} GROUP BY dt)),
  s AS (SELECT arg_max(equity, dt) - 1 AS total_return, avg(ret) * sqrt(252) / stddev_pop(ret) AS sharpe, avg(ret) * sqrt(252) / (stddev_pop(ret) FILTER (ret < 0)) AS sortino, max(dd) AS max_drawdown, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, count(*) AS bars, avg(turnover) AS turnover FROM c)
  SELECT s.*, total_return / max_drawdown AS calmar, long, short, long + short AS gross, long - short AS net FROM s, e""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.portfolio_stats(curve(spark, d), held(spark, d))


@query("attribution", "symbol:s pnl:d", f"SELECT symbol, sum(w * ret) AS pnl FROM {WEIGHTS} GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.attribution(held(spark, d))


@query("rejection_waterfall", "reason:s n:i rate:d", "SELECT reason, count(*) AS n, count(*) / (SELECT count(*) FROM ledger) AS rate FROM ledger GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.waterfall(ledger(spark, d), "reason")


@query("top_pairs", "l_suppkey:i value_k:d n:i", "SELECT l_suppkey, sum(l_extendedprice * (l_tax - l_discount)) / 1e6 AS value_k, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    top = metrics.top_by(table(spark, d, "lineitem"), ["l_suppkey"], F.sum(F.col("l_extendedprice") * (F.col("l_tax") - F.col("l_discount"))), 10)
    return top.withColumn("value_k", F.col("value") / 1e6)


@query("topk_features", "feature:i corr:d rank:i", "SELECT * FROM (SELECT feature, corr, row_number() OVER (ORDER BY corr DESC, feature) AS rank FROM (SELECT feature, coalesce(abs(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)), 0) AS corr FROM (SELECT unnest(range(0, 64)) AS feature, unnest(embedding)::DOUBLE AS x, label::DOUBLE AS y FROM embeddings) GROUP BY 1)) WHERE rank <= 10 OR feature IN (0, 1)")
def _(spark: SparkSession, d: str) -> DataFrame:
    long = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("feature", "x"), F.col("label").cast("double").alias("y"))
    return metrics.feature_label_corr(long.withColumn("x", F.col("x").cast("double")), 10, ["0", "1"])
