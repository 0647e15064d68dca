"""Queries over ticks and bars: scans, bars, alignment, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import align, bars
from barloom.plans.registry import hourly, query, quotes, table, ticks
from barloom.sources import readers

BAR = "symbol:s dt:t o:d h:d l:d c:d sp:d tk:i"


@query("mid_spread", "id:i symbol:s mid:d spread:d", "SELECT id, symbol, (bid + ask) / 2 AS mid, ask - bid AS spread FROM ticks")
def _(spark: SparkSession, d: str) -> DataFrame:
    return bars.mid_spread(ticks(spark, d))


FFILL = "SELECT id, symbol, ts, last_value(bid IGNORE NULLS) OVER w AS bid, last_value(ask IGNORE NULLS) OVER w AS ask FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, id ROWS UNBOUNDED PRECEDING)"


@query("tick_ffill", "id:i symbol:s ts:t bid:d ask:d", FFILL)
def _(spark: SparkSession, d: str) -> DataFrame:
    return bars.tick_ffill(ticks(spark, d))


@query("drop_unquoted", "id:i symbol:s ts:t bid:d ask:d", f"SELECT * FROM ({FFILL}) WHERE bid IS NOT NULL AND ask IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return bars.drop_unquoted(bars.tick_ffill(ticks(spark, d)))


@query("date_range_filter", "id:i symbol:s ts:t mid:d", "SELECT id, symbol, ts, mid FROM quotes WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 23:59:59.999'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return bars.date_range_filter(quotes(spark, d), "2024-01-05", "2024-01-09")


@query("flag_bits", "id:i bid_tick:b ask_tick:b", "SELECT id, (flags & 2) > 0 AS bid_tick, (flags & 4) > 0 AS ask_tick FROM ticks")
def _(spark: SparkSession, d: str) -> DataFrame:
    return bars.flag_bits(ticks(spark, d))


@query("bars_1s", f"{BAR} bid_ticks:i ask_ticks:i", "SELECT symbol, date_trunc('second', ts) AS dt, arg_min(mid, id) AS o, max(mid) AS h, min(mid) AS l, arg_max(mid, id) AS c, avg(spread) AS sp, count(*) AS tk, count(*) FILTER ((flags & 2) > 0) AS bid_ticks, count(*) FILTER ((flags & 4) > 0) AS ask_ticks FROM quotes GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return bars.bars_1s(quotes(spark, d))


@query("bars_1m", "symbol:s dt:t o:d h:d l:d c:d sp:d tk:i", "SELECT symbol, date_trunc('minute', ts) AS dt, arg_min(mid, id) AS o, max(mid) AS h, min(mid) AS l, arg_max(mid, id) AS c, round(avg(spread) / CASE WHEN symbol = 'view' THEN 0.01 ELSE 0.0001 END, 2) AS sp, count(*) AS tk FROM quotes GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    q = quotes(spark, d)
    pip = q.select("symbol").distinct().withColumn("pip", F.when(F.col("symbol") == "view", 0.01).otherwise(0.0001))
    return bars.bars_1m(q, pip)


@query("bars_hour", BAR, "SELECT * FROM bars")
def _(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d)


@query("tick_path", "symbol:s dt:t path:a", "SELECT symbol, dt, list(mid ORDER BY id) AS path FROM (SELECT *, date_trunc('hour', ts) AS dt, max(mid) OVER b AS hi, min(mid) OVER b AS lo, lead(mid) OVER (PARTITION BY symbol, date_trunc('hour', ts) ORDER BY ts, id) AS nx FROM quotes WINDOW b AS (PARTITION BY symbol, date_trunc('hour', ts) ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE hi IS NULL OR mid > hi OR mid < lo OR nx IS NULL GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return bars.tick_path(quotes(spark, d), "hour")


def _rolled(bucket: str) -> str:
    return f"SELECT symbol, {bucket} AS dt, arg_min(o, dt) AS o, max(h) AS h, min(l) AS l, arg_max(c, dt) AS c, avg(sp) AS sp, sum(tk) AS tk FROM bars GROUP BY symbol, {bucket}"


@query("bars_rollup_left", BAR, _rolled("time_bucket(INTERVAL 4 HOUR, dt, TIMESTAMP '2024-01-01')"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return bars.bars_rollup_left(hourly(spark, d), "4 hours")


@query("bars_rollup_right", BAR, _rolled("time_bucket(INTERVAL 4 HOUR, dt - INTERVAL 1 MICROSECOND, TIMESTAMP '2024-01-01') + INTERVAL 4 HOUR"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return bars.bars_rollup_right(hourly(spark, d), "4 hours")


@query("bars_rollup_week", BAR, _rolled("date_trunc('week', dt)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return bars.bars_rollup_left(hourly(spark, d), "week")


@query("bars_multi_tf", "tf:s symbol:s dt:t o:d h:d l:d c:d sp:d tk:i", " UNION ALL ".join(f"SELECT '{u}' AS tf, symbol, date_trunc('{u}', ts) AS dt, arg_min(mid, id) AS o, max(mid) AS h, min(mid) AS l, arg_max(mid, id) AS c, avg(spread) AS sp, count(*) AS tk FROM quotes GROUP BY 2, 3" for u in ("hour", "day", "week", "month")))
def _(spark: SparkSession, d: str) -> DataFrame:
    return bars.bars_multi_tf(quotes(spark, d), ["hour", "day", "week", "month"])


@query("bars_from_candles", "symbol:s gap_s:d", "SELECT symbol, quantile_cont(gap, 0.5) AS gap_s FROM (SELECT symbol, date_diff('second', lag(dt) OVER (PARTITION BY symbol ORDER BY dt), dt) AS gap FROM bars) WHERE gap IS NOT NULL GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return bars.median_gap(hourly(spark, d))


@query("dedupe_latest", "user_id:i day:s event_id:i value:d", "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("day", F.to_date("ts").cast("string"))
    return bars.dedupe_latest(e, ["user_id", "day"], F.col("event_id"))


@query("union_timeline", "dt:t", "SELECT DISTINCT dt FROM bars")
def _(spark: SparkSession, d: str) -> DataFrame:
    return align.union_timeline(hourly(spark, d))


COMMON = "SELECT dt FROM bars GROUP BY 1 HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars)"


@query("intersect_timeline", "dt:t", COMMON)
def _(spark: SparkSession, d: str) -> DataFrame:
    return align.intersect_timeline(hourly(spark, d))


@query("align_intersect", BAR, f"SELECT * FROM bars WHERE dt IN ({COMMON})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return align.align_intersect(hourly(spark, d))


def _grid(timeline: str) -> str:
    return f"SELECT t.dt, s.symbol, o, h, l, c, coalesce(sp, 0) AS sp, coalesce(tk, 0) AS tk, c IS NOT NULL AS real FROM ({timeline}) t CROSS JOIN (SELECT DISTINCT symbol FROM bars) s LEFT JOIN bars b ON b.dt = t.dt AND b.symbol = s.symbol"


UNION = _grid("SELECT DISTINCT dt FROM bars")
ALIGNED = "symbol:s dt:t o:d h:d l:d c:d sp:d tk:i real:b"


@query("align_union", ALIGNED, UNION)
def _(spark: SparkSession, d: str) -> DataFrame:
    b = hourly(spark, d)
    return align.align_union(b, b)


PAST = "(PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING)"
NEXT = "(PARTITION BY symbol ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("align_union_ffill", ALIGNED, "SELECT * FROM (SELECT symbol, dt, " + ", ".join(f"last_value({p} IGNORE NULLS) OVER {PAST} AS {p}" for p in "ohlc") + f", sp, tk, real FROM ({UNION})) WHERE c IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = hourly(spark, d)
    return align.align_union_ffill(b, b)


CALENDAR = _grid("SELECT unnest(generate_series((SELECT min(dt) FROM bars), (SELECT max(dt) FROM bars), INTERVAL 1 HOUR)) AS dt")


@query("align_calendar_mask", ALIGNED, CALENDAR)
def _(spark: SparkSession, d: str) -> DataFrame:
    b = hourly(spark, d)
    return align.align_calendar_mask(b, b, "1 HOUR")


@query("align_carry", ALIGNED, "SELECT symbol, dt, " + ", ".join(f"coalesce(last_value({p} IGNORE NULLS) OVER {PAST}, first_value({p} IGNORE NULLS) OVER {NEXT}) AS {p}" for p in "ohlc") + f", sp, tk, real FROM ({CALENDAR})")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = hourly(spark, d)
    return align.align_carry(align.align_calendar_mask(b, b, "1 HOUR"))


@query("interpolate_linear", "symbol:s dt:t c:d", f"""
  SELECT symbol, dt, CASE WHEN c IS NOT NULL THEN c WHEN x0 IS NULL THEN x1 WHEN x1 IS NULL THEN x0 ELSE x0 + (x1 - x0) * (rn - i0) / (i1 - i0) END AS c FROM (
    SELECT symbol, dt, c, rn, last_value(c IGNORE NULLS) OVER {PAST} AS x0, first_value(c IGNORE NULLS) OVER {NEXT} AS x1,
           last_value(CASE WHEN c IS NOT NULL THEN rn END IGNORE NULLS) OVER {PAST} AS i0, first_value(CASE WHEN c IS NOT NULL THEN rn END IGNORE NULLS) OVER {NEXT} AS i1
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS rn FROM ({CALENDAR})))""")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = hourly(spark, d)
    return align.interpolate_linear(align.align_calendar_mask(b, b, "1 HOUR"), ["c"])


DAY = "SELECT symbol, date_trunc('day', ts) AS dt, arg_max(mid, id) AS c FROM quotes GROUP BY 1, 2"


@query("asof_backward", "symbol:s dt:t c:d day_c:d", f"SELECT b.symbol, b.dt, b.c, d.c AS day_c FROM bars b ASOF LEFT JOIN (SELECT symbol, dt + INTERVAL 1 DAY AS dt, c FROM ({DAY})) d ON b.symbol = d.symbol AND b.dt >= d.dt")
def _(spark: SparkSession, d: str) -> DataFrame:
    coarse = bars.bars(quotes(spark, d), "day").select("symbol", (F.col("dt") + F.expr("INTERVAL 1 DAY")).alias("dt"), F.col("c").alias("day_c"))
    return align.asof_backward(hourly(spark, d).select("symbol", "dt", "c"), coarse, ["day_c"])


@query("dim_join", "c_custkey:i n_name:s r_name:s c_acctbal:d", "SELECT c_custkey, n_name, r_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))


@query("asset_class_join", "n_name:s r_name:s members:i", "SELECT n_name, r_name, count(c_custkey) AS members FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("members"))
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.join(per, F.col("c_nationkey") == F.col("n_nationkey"), "left").withColumn("members", F.coalesce("members", F.lit(0)))


@query("pair_self_join", "dt:t a:s b:s x:d y:d", "SELECT x.dt, x.symbol AS a, y.symbol AS b, x.c AS x, y.c AS y FROM bars x JOIN bars y ON x.dt = y.dt AND x.symbol < y.symbol")
def _(spark: SparkSession, d: str) -> DataFrame:
    return align.pair_self_join(hourly(spark, d), "c")


SECOND = "(SELECT symbol, date_trunc('second', ts) AS dt, arg_min(mid, id) AS o, arg_max(mid, id) AS c, max(mid) AS h, min(mid) AS l, avg(spread) AS sp, count(*) AS tk FROM quotes GROUP BY 1, 2)"


MICRO_BARS = f"(SELECT *, tk AS tick_velocity, sp * 1e3 AS spread_z, 2 * c - h - l AS bid_ask_imbalance, c - o AS price_velocity FROM {SECOND})"
MICRO_SQL = f"""SELECT b.symbol, b.dt, count(m.dt) AS n, coalesce(avg(tick_velocity), 0) AS tick_velocity_mean, coalesce(stddev_pop(tick_velocity), 0) AS tick_velocity_std, coalesce(avg(spread_z), 0) AS spread_z_mean, coalesce(arg_max(spread_z, m.dt), 0) AS spread_z_last,
  coalesce(avg(bid_ask_imbalance), 0) AS bid_ask_imbalance_mean, coalesce(max(abs(bid_ask_imbalance)), 0) AS bid_ask_imbalance_abs_max, coalesce(arg_max(price_velocity, m.dt), 0) AS price_velocity_last
  FROM bars b LEFT JOIN {MICRO_BARS} m ON m.symbol = b.symbol AND m.dt < b.dt AND m.dt >= b.dt - INTERVAL 3600 SECOND GROUP BY 1, 2"""


def micro_bars(spark: SparkSession, d: str) -> DataFrame:
    """Second bars with the four channels that windows before an entry are summed up from."""
    b = bars.bars_1s(quotes(spark, d))
    return b.withColumns({"tick_velocity": F.col("tk"), "spread_z": F.col("sp") * 1e3, "bid_ask_imbalance": 2 * F.col("c") - F.col("h") - F.col("l"), "price_velocity": F.col("c") - F.col("o")})


@query("interval_join_window", " ".join(["symbol:s dt:t n:i", *(f"{c}:d" for c in align.MICRO)]), MICRO_SQL)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Events are sparse, so the window is an hour."""
    return align.interval_join_window(hourly(spark, d).select("symbol", "dt"), micro_bars(spark, d), 3600)


FILLED = """
  WITH e AS (SELECT id AS event_id, symbol, ts AS dt, CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS dir, mid * 0.051709318273 AS atr, mid * 0.010347123457 AS pip FROM quotes),
  n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS no FROM """ + SECOND + """),
  f AS (SELECT e.*, (SELECT min(no) FROM n WHERE n.symbol = e.symbol AND n.dt >= e.dt) AS no FROM e),
  b AS (SELECT event_id, list({'t': n.dt, 'o': n.o, 'h': n.h, 'l': n.l, 'c': n.c} ORDER BY n.dt) AS bars FROM f JOIN n ON n.symbol = f.symbol AND n.no >= f.no AND n.no < f.no + 5 GROUP BY 1),
  x AS (SELECT e.*, b.bars, b.bars[1].o AS mid, unnest(range(6)) AS act FROM e LEFT JOIN b USING (event_id)),
  l AS (SELECT *, mid - dir * CASE act WHEN 2 THEN 2 * pip WHEN 3 THEN 3 * pip WHEN 4 THEN 0.5 * atr WHEN 5 THEN pip END AS lim FROM x),
  r AS (SELECT *, CASE WHEN act = 1 AND mid IS NOT NULL THEN 1 ELSE list_position(list_transform(bars, lambda v: CASE WHEN dir > 0 THEN v.l <= lim - pip ELSE v.h >= lim + pip END), true) END AS pos, len(list_filter(bars, lambda v: CASE WHEN dir > 0 THEN v.l <= lim + pip ELSE v.h >= lim - pip END)) > 0 AS near FROM l),
  p AS (SELECT *, act <> 0 AND mid IS NOT NULL AND coalesce(pos > 0, false) AS filled, CASE WHEN act = 1 THEN mid + dir * greatest(0.01 * greatest(atr, 1e-8), pip) ELSE lim END AS price FROM r),
  q AS (SELECT *, CASE WHEN filled THEN bars[pos:] END AS rest FROM p),
  g AS (SELECT *, CASE WHEN filled THEN list_max(list_transform(rest, lambda v: dir * (CASE WHEN dir > 0 THEN v.h ELSE v.l END - price))) ELSE 0 END AS mfe, CASE WHEN filled THEN list_max(list_transform(rest, lambda v: -dir * (CASE WHEN dir > 0 THEN v.l ELSE v.h END - price))) ELSE 0 END AS mae FROM q)
  SELECT event_id, ['reject_wait', 'market_now', 'limit_2tick', 'limit_3tick', 'limit_half_atr', 'passive_limit_1tick'][act + 1] AS action, filled, act <> 0 AND NOT filled AS no_fill, act <> 0 AND mid IS NOT NULL AND NOT filled AND coalesce(near, false) AS near_miss, rest[1].t AS fill_dt, CASE WHEN filled THEN price END AS fill_price,
    CASE WHEN act = 0 THEN -5e-5 WHEN mid IS NULL THEN 0 WHEN NOT filled THEN -2.5e-5 ELSE dir * (rest[-1].c - price) + 0.25 * greatest(mfe, 0) - 0.1 * greatest(mae, 0) END AS reward, CASE WHEN filled THEN dir * (mid - price) ELSE 0 END AS edge, CASE WHEN filled THEN abs(price - mid) ELSE 0 END AS slippage, mfe, mae FROM g"""


@query("first_fill_join", "event_id:i action:s filled:b no_fill:b near_miss:b fill_dt:t fill_price:d reward:d edge:d slippage:d mfe:d mae:d", FILLED)
def _(spark: SparkSession, d: str) -> DataFrame:
    """A pip is about a hundredth of the event's price, so that prices of events far apart fill and miss; the factors keep rewards off rounding ties."""
    q = quotes(spark, d)
    events = q.select(F.col("id").alias("event_id"), "symbol", F.col("ts").alias("dt"), F.when(F.col("k") % 2 == 0, 1).otherwise(-1).alias("direction"), (F.col("mid") * 0.051709318273).alias("atr"), (F.col("mid") * 0.010347123457).alias("pip"))
    return align.first_fill_join(events, bars.bars_1s(q), 5, F.col("pip"))


LEGS = "SELECT DISTINCT upper(substr(p_name, 1, 6)) AS symbol FROM part WHERE length(p_name) >= 6"


@query("shared_currency", "a:s b:s", f"WITH s AS ({LEGS}), g AS (SELECT symbol, substr(symbol, 1, 3) AS cur FROM s UNION SELECT symbol, substr(symbol, 4, 3) FROM s) SELECT DISTINCT x.symbol AS a, y.symbol AS b FROM g x JOIN g y ON x.cur = y.cur AND x.symbol < y.symbol")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").where(F.length("p_name") >= 6).select(F.upper(F.substring("p_name", 1, 6)).alias("symbol")).distinct()
    return align.shared_currency(s)


@query("missing_anti", "n_nationkey:i status:s", "SELECT n_nationkey, 'missing' AS status FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000) UNION ALL SELECT DISTINCT s_nationkey, 'unexpected' FROM supplier WHERE s_acctbal > 7000 AND s_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return align.missing_anti(table(spark, d, "nation"), table(spark, d, "supplier").where("s_acctbal > 7000").withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey")


@query("except_symbols", "c_custkey:i", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey").exceptAll(table(spark, d, "orders").where("o_totalprice > 400000").select("o_custkey").distinct())


@query("file_instrument_match", "file:s symbol:s", "SELECT file, symbol FROM (SELECT 'ticks/' || p_name || '_' || p_partkey || '.csv' AS file, b AS symbol, row_number() OVER (PARTITION BY p_partkey ORDER BY length(b) DESC NULLS LAST, b) AS rn FROM part LEFT JOIN (SELECT DISTINCT split_part(p_name, ' ', 2) AS b FROM part) ON contains(upper('ticks/' || p_name || '_' || p_partkey || '.csv'), upper(b))) WHERE rn = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    files = p.select(F.concat(F.lit("ticks/"), "p_name", F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".csv")).alias("file"))
    return readers.file_instrument_match(files, p.select(F.split("p_name", " ")[1].alias("symbol")).distinct())
