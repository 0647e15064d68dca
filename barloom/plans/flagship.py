"""The flagship query: quotes filled, brought to bars, with returns and spread z-scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.operators import bars
from barloom.operators.indicators import log_ret, spread_z_incl
from barloom.plans.registry import query, ticks

_BARS = """SELECT symbol, date_trunc('hour', ts) AS dt, arg_min(mid, id) AS o, max(mid) AS h, min(mid) AS l, arg_max(mid, id) AS c, avg(spread) AS sp, count(*) AS tk FROM (
  SELECT id, symbol, ts, (bid + ask) / 2 AS mid, ask - bid AS spread FROM (
    SELECT id, symbol, ts, last_value(bid IGNORE NULLS) OVER w AS bid, last_value(ask IGNORE NULLS) OVER w AS ask FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, id ROWS UNBOUNDED PRECEDING))
  WHERE bid IS NOT NULL AND ask IS NOT NULL) GROUP BY 1, 2"""


@query(
    "flagship",
    "symbol:s dt:t o:d h:d l:d c:d sp:d tk:i ret_1:d sp_z:d",
    f"""SELECT *, coalesce(ln(nullif(c, 0) / nullif(lag(c) OVER (PARTITION BY symbol ORDER BY dt), 0)), 0) AS ret_1,
      round((sp - avg(sp) OVER w) / (coalesce(stddev_samp(sp) OVER w, 0) + 1e-10), 4) AS sp_z FROM ({_BARS})
      WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = bars.drop_unquoted(bars.tick_ffill(ticks(spark, sf_dir)))
    return spread_z_incl(log_ret(bars.bars(bars.mid_spread(quoted), "hour")))
