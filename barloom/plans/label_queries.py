"""Queries of labels and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import calendar, numeric
from barloom.operators import indicators as ind
from barloom.operators import labels
from barloom.plans.indicator_queries import ALL, KEY, SESSION, TR, over
from barloom.plans.registry import SQL, hourly, query, table


@query("label_next_bar", f"{KEY} label:i", f"SELECT symbol, dt, CASE WHEN lead(c) OVER {ALL} > c THEN 1 WHEN lead(c) OVER {ALL} <= c THEN 0 END AS label FROM bars")
def _(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_next_bar(hourly(spark, d))


FWD = f"(SELECT *, ln(nullif(lead(c) OVER {ALL}, 0) / nullif(c, 0)) AS fwd FROM bars)"


@query("forward_return", f"{KEY} fwd:d fwd_class:i", f"SELECT symbol, dt, fwd, CASE WHEN fwd > 1e-4 THEN 2 WHEN fwd < -1e-4 THEN 0 WHEN fwd IS NOT NULL THEN 1 END AS fwd_class FROM {FWD}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return labels.forward_return(hourly(spark, d))


@query("label_threshold", f"{KEY} fwd_sum:d label:i", "SELECT symbol, dt, s AS fwd_sum, CASE WHEN s - coalesce(sp / nullif(c, 0), 0) > 0.5 THEN 2 WHEN s + coalesce(sp / nullif(c, 0), 0) < -0.5 THEN 0 ELSE 1 END AS label FROM (SELECT *, CASE WHEN count(*) OVER w = 5 THEN sum(ret) OVER w END AS s FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))")
def _(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_threshold(hourly(spark, d), 5, 0.5)


@query("label_quantile", f"{KEY} label:i", """
  WITH f AS (SELECT symbol, dt, CASE WHEN count(*) OVER w = 3 THEN sum(ret) OVER w END AS fwd, tk % 5 <> 0 AS real FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
  r AS (SELECT *, row_number() OVER (PARTITION BY symbol, able ORDER BY fwd, dt) AS rn, count(*) OVER (PARTITION BY symbol, able) AS n FROM (SELECT *, fwd IS NOT NULL AND real AS able FROM f))
  SELECT symbol, dt, CASE WHEN NOT able THEN 1 WHEN rn > n - floor(n * 30 / 100) THEN 2 WHEN rn <= floor(n * 30 / 100) THEN 0 ELSE 1 END AS label FROM r""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_quantile(hourly(spark, d).withColumn("real", F.col("tk") % 5 != 0), 3, 30, 30, "real")


AHEAD = "(PARTITION BY symbol ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)"


COST = "greatest(CASE WHEN sp < 50 * 1e-4 THEN sp ELSE sp * 1e-4 / 10 END, 0)"


@query("label_triple_barrier", f"{KEY} barrier:d label:i barrier_valid:b", f"""
  WITH a AS (SELECT *, greatest(2 * {COST}, CASE WHEN rn >= 3 THEN 0.35 * avg(tr) OVER {over(13)} END) AS barrier, CASE WHEN rn >= 3 THEN avg(tr) OVER {over(13)} END AS atr, list({{'h': h, 'l': l, 'x': c}}) OVER {AHEAD} AS w FROM {TR}),
  t AS (SELECT *, list_filter(list_transform(coalesce(w, []), lambda x: CASE WHEN x.h >= c + barrier AND x.l <= c - barrier THEN CASE WHEN x.x >= c THEN 1 ELSE -1 END WHEN x.h >= c + barrier THEN 1 WHEN x.l <= c - barrier THEN -1 ELSE 0 END), lambda v: v <> 0) AS hits FROM a)
  SELECT symbol, dt, barrier, CASE WHEN barrier IS NOT NULL THEN coalesce(hits[1], 0) END AS label, rn - 1 >= 14 AND len(coalesce(w, [])) = 6 AND atr IS NOT NULL AND len(hits) > 0 AS barrier_valid FROM t""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_triple_barrier(ind.atr_series(hourly(spark, d)), 6, "atr_series", numeric.pip_size(F.col("symbol")))


@query("label_smooth", f"{KEY} smooth:d", f"SELECT symbol, dt, CASE WHEN lead(c) OVER {ALL} > c THEN 1 ELSE 0 END * 0.9 + 0.05 AS smooth FROM bars")
def _(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_next_bar(hourly(spark, d)).withColumn("smooth", labels.label_smooth(F.coalesce("label", F.lit(0)), 0.1))


ENTRY = f"""(WITH i AS (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN s <> lag(s) OVER {ALL} THEN 1 ELSE 0 END AS ch FROM (SELECT *, {SESSION.format('dt')} AS s, greatest(c, 1e-6) AS cc FROM bars))),
  r AS (SELECT *, row_number() OVER {ALL} AS rn, coalesce(ln(cc / lag(cc) OVER {ALL}), 0) AS r, row_number() OVER (PARTITION BY symbol, island ORDER BY dt) AS n, sum((tk > 1)::INT) OVER (PARTITION BY symbol, island ORDER BY dt ROWS UNBOUNDED PRECEDING) AS rl FROM i),
  o AS (SELECT *, max(CASE WHEN tk > 1 AND rl <= 3 THEN h END) OVER p AS hi, min(CASE WHEN tk > 1 AND rl <= 3 THEN l END) OVER p AS lo, max(CASE WHEN tk > 1 AND rl <= 3 THEN c END) OVER p AS top, max(rl) OVER p AS k FROM r WINDOW p AS (PARTITION BY symbol, island)),
  f AS (SELECT *, CASE WHEN s >= 2 AND k >= 3 THEN (c - (hi + lo) / 2) / greatest(hi - lo, greatest(top, 1e-6) * 1e-6) ELSE 0 END AS brk, CASE WHEN rn >= 2 THEN sum(r) OVER {over(2)} ELSE 0 END AS m3, CASE WHEN rn >= 3 THEN sum(r) OVER {over(5)} ELSE 0 END AS m6, CASE WHEN rn >= 3 THEN sqrt(avg(r * r) OVER {over(5)}) ELSE 0 END AS v6,
    CASE WHEN rn >= 6 THEN sqrt(avg(r * r) OVER {over(11)}) ELSE 0 END AS v12, CASE WHEN rn >= 3 THEN avg(tk) OVER {over(11)} ELSE 0 END AS tm, CASE WHEN rn >= 3 THEN stddev_pop(tk) OVER {over(11)} ELSE 0 END AS td FROM o),
  q AS (SELECT f.symbol, f.dt, barrier_valid, tk > 1 AS real, s >= 2 AND n >= 3 AS ready, CASE WHEN label > 0.5 THEN 1 ELSE -1 END AS side, brk, 0.65 * m3 + 0.35 * m6 AS mv, v12, least(greatest(1 - sp / cc / greatest(v6, v12, 5e-5) / 5, 0), 1) AS spread_quality, CASE WHEN td > 1e-6 THEN (tk - tm) / greatest(td, 1e-6) ELSE 0 END AS shock, CASE WHEN v12 > 1e-8 THEN v6 / greatest(v12, 1e-8) ELSE 0 END AS ratio FROM f JOIN ({SQL['label_triple_barrier']}) t ON t.symbol = f.symbol AND t.dt = f.dt)
  SELECT *, 0.4 * least(greatest((side * mv / greatest(v12, 1e-6) + 0.05) / 0.55, 0), 1) + 0.25 * least(greatest((side * brk + 0.1) / 0.6, 0), 1) + 0.2 * exp(-abs(ln(least(greatest(ratio, 1e-3), 10)))) + 0.1 * spread_quality + 0.05 * least(greatest(0.5 + 0.25 * shock, 0), 1) AS entry_score FROM q)"""


@query("label_entry_scalp", f"{KEY} spread_quality:d entry_score:d entry:i", f"SELECT *, CASE WHEN barrier_valid AND real AND ready AND spread_quality >= 0.2 AND entry_score >= 0.48 THEN 1 ELSE 0 END AS entry FROM {ENTRY}")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = labels.label_triple_barrier(ind.atr_series(hourly(spark, d)), 6, "atr_series", numeric.pip_size(F.col("symbol"))).withColumns({"session_code": calendar.session_code(F.col("dt")), "real": F.col("tk") > 1})
    return labels.label_entry(labels.entry_quality(b, "session_code", "label"))


@query("valid_rows", KEY, "SELECT symbol, dt FROM (SELECT symbol, dt, tk > 1 AS real, row_number() OVER (PARTITION BY symbol ORDER BY dt) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n, sum(CASE WHEN tk > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING) AS r FROM bars) WHERE real AND rn >= 32 AND rn < n - 6 AND r >= 32")
def _(spark: SparkSession, d: str) -> DataFrame:
    return labels.valid_rows(hourly(spark, d).withColumn("real", F.col("tk") > 1))


def _blocks(block: str) -> str:
    return f"""WITH n AS (SELECT dt, dense_rank() OVER (ORDER BY b) - 1 AS blk, row_number() OVER (ORDER BY dt) AS bar FROM (SELECT DISTINCT dt, {block} AS b FROM bars)),
      f AS (SELECT blk - 1 AS fold, max(bar) AS train_end, (SELECT max(blk) - 1 FROM n) AS last FROM n GROUP BY blk HAVING blk < (SELECT max(blk) - 1 FROM n) AND blk >= 1),
      p AS (SELECT dt, fold, CASE WHEN blk > last THEN 'holdout' WHEN blk = fold + 2 THEN 'valid' WHEN bar <= train_end - 6 THEN 'train' END AS part FROM n JOIN f ON blk <= fold + 2 OR blk > last)
      SELECT fold, symbol, b.dt, part FROM bars b JOIN p ON b.dt = p.dt WHERE part IS NOT NULL"""


WEEKLY = _blocks("date_trunc('week', dt)")
FOLD = "fold:i symbol:s dt:t part:s"


@query("folds_walkforward", FOLD, WEEKLY)
def _(spark: SparkSession, d: str) -> DataFrame:
    return labels.folds_walkforward(hourly(spark, d))


def _expanding(rows: str, block: str, min_train: int) -> str:
    return f"""WITH r AS ({rows}), n AS (SELECT dt, b, row_number() OVER (ORDER BY dt) AS bar FROM (SELECT DISTINCT dt, {block} AS b FROM r)), u AS (SELECT dt, bar, dense_rank() OVER (ORDER BY b) - 1 AS own FROM n WHERE b IS NOT NULL),
      f AS (SELECT own AS blk, min(bar) AS start, own - {min_train} AS fold FROM u GROUP BY 1 HAVING own >= {min_train}),
      p AS (SELECT dt, fold, CASE WHEN own = blk THEN 'valid' WHEN bar < start - 5 OR bar >= start THEN 'train' END AS part FROM u JOIN f ON own <= blk)
      SELECT fold, symbol, r.dt, part FROM r JOIN p ON r.dt = p.dt WHERE part IS NOT NULL"""


DAILY = "SELECT o_orderpriority AS symbol, o_orderdate AS dt FROM orders GROUP BY 1, 2"
QUARTERS = _expanding(DAILY, "CASE WHEN dt < TIMESTAMP '2000-01-01' THEN year(dt) || 'Q' || quarter(dt) END", 12)
MONTHS = _expanding(DAILY, "CASE WHEN dt < TIMESTAMP '2000-01-01' THEN date_trunc('month', dt) END", 50)
OVERLAP = _expanding(f"SELECT symbol, dt, blk FROM bars LEFT JOIN (SELECT day, (row_number() OVER (ORDER BY day) - 1) // 3 AS blk FROM (SELECT DISTINCT date_trunc('day', dt) AS day FROM bars WHERE {SESSION.format('dt')} = 4)) ON day = date_trunc('day', dt)", "blk", 2)


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("dt")).agg(F.avg("o_totalprice").alias("c"))


def _quarters(spark: SparkSession, d: str) -> DataFrame:
    return labels.folds_expanding(_daily(spark, d), F.when(F.year("dt") < 2000, calendar.quarter_id(F.col("dt"))), 12)


@query("folds_quarter", FOLD, QUARTERS)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _quarters(spark, d)


@query("folds_month", FOLD, MONTHS)
def _(spark: SparkSession, d: str) -> DataFrame:
    return labels.folds_expanding(_daily(spark, d), F.when(F.year("dt") < 2000, F.date_trunc("month", F.col("dt"))), 50)


@query("folds_overlap_days", FOLD, OVERLAP)
def _(spark: SparkSession, d: str) -> DataFrame:
    b = hourly(spark, d)
    return labels.folds_expanding(labels.overlap_blocks(b, calendar.session_code(F.col("dt")), 3), F.col("block"), 2)


@query("folds_metadata", "fold:i part:s first:t last:t times:i", f"SELECT fold, part, min(dt) AS first, max(dt) AS last, count(DISTINCT dt) AS times FROM ({QUARTERS}) GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return labels.folds_metadata(_quarters(spark, d))


@query("folds_timeseries", FOLD, """WITH t AS (SELECT DISTINCT dt FROM bars), s AS (SELECT floor(count(*) / 5) AS size FROM t), n AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS bar, size, floor((row_number() OVER (ORDER BY dt) - 1) / size) AS blk FROM t, s),
  p AS (SELECT dt, fold, CASE WHEN blk = fold THEN 'valid' WHEN bar < fold * size - 5 THEN 'train' END AS part FROM n, (SELECT unnest([1, 2, 3, 4]) AS fold)) SELECT fold, symbol, b.dt, part FROM bars b JOIN p ON b.dt = p.dt WHERE part IS NOT NULL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return labels.folds_timeseries(hourly(spark, d))


@query("train_only_scaler", "fold:i symbol:s dt:t part:s scaled:d", f"WITH f AS ({WEEKLY}), j AS (SELECT f.*, c FROM f JOIN bars USING (symbol, dt)), s AS (SELECT fold, avg(c) AS m, stddev_pop(c) AS s FROM j WHERE part = 'train' GROUP BY 1) SELECT j.fold, symbol, dt, part, (c - m) / (s + 1e-10) AS scaled FROM j JOIN s ON j.fold = s.fold")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = hourly(spark, d)
    return labels.train_only_scaler(b.select("symbol", "dt", "c"), labels.folds_walkforward(b), "c")
