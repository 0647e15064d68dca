"""Registration of queries with the SQL that gives the same rows, and the views both start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.numeric import log_ratio

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The queries' own SQL, for those that build on others.
SQL: dict[str, str] = {}

#: Views of the given tables in SQL: ticks of event types, hourly bars, their returns, scored rows and a ledger.
VIEWS = """
quotes AS (
  SELECT event_id AS id, event_type AS symbol, ts, value AS mid, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         value * (1 + CAST(json_extract_string(props, '$.k') AS BIGINT)) * 1.23456789e-5 AS spread, 2 + 2 * (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) AS flags
  FROM events),
ticks AS (
  SELECT id, symbol, ts, flags, CASE WHEN flags <> 4 THEN mid - spread / 2 END AS bid, CASE WHEN flags <> 2 THEN mid + spread / 2 END AS ask FROM quotes),
bars AS (
  SELECT symbol, date_trunc('hour', ts) AS dt, arg_min(mid, id) AS o, max(mid) AS h, min(mid) AS l, arg_max(mid, id) AS c, avg(spread) AS sp, count(*) AS tk
  FROM quotes GROUP BY 1, 2),
rets AS (
  SELECT *, coalesce(ln(nullif(c, 0) / nullif(lag(c) OVER (PARTITION BY symbol ORDER BY dt), 0)), 0) AS ret FROM bars),
scored AS (
  SELECT id, symbol, ts AS dt, k / 100.0::DOUBLE AS p, CASE WHEN lead(mid) OVER (PARTITION BY symbol ORDER BY ts, id) > mid THEN 1 ELSE 0 END AS y,
         ln(nullif(lead(mid) OVER (PARTITION BY symbol ORDER BY ts, id), 0) / nullif(mid, 0)) AS fwd FROM quotes),
ledger AS (
  SELECT l_extendedprice * (l_tax - l_discount) AS pnl, l_returnflag AS reason, l_quantity AS size, l_shipdate AS day, l_orderkey, l_linenumber FROM lineitem)
"""


def query(name: str, columns: str, sql: str | None = None) -> Callable[[Query], Query]:
    """columns: name:kind in order; d doubles rounded to 6 places, i integers as bigint, a arrays of doubles, anything else as it is.

    sql may use VIEWS and the tables; without it there is no SQL form.
    """
    spec = [c.split(":") for c in columns.split()]

    def keep(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            made = {"d": lambda c: F.round(F.col(c).cast("double"), 6) + 0.0, "i": lambda c: F.col(c).cast("bigint"), "a": lambda c: F.transform(c, lambda x: F.round(x, 6) + 0.0)}
            return df.select(*(made.get(k, F.col)(c).alias(c) for c, k in spec))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
            out = {"d": "round(CAST({0} AS DOUBLE), 6) + 0.0 AS {0}", "i": "CAST({0} AS BIGINT) AS {0}", "a": "list_transform({0}, lambda x: round(x, 6) + 0.0) AS {0}"}
            ORACLES[name] = f"WITH {VIEWS}, result AS ({sql}) SELECT " + ", ".join(out.get(k, "{0}").format(c) for c, k in spec) + " FROM result"
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("symbol"), "ts", F.col("value").alias("mid"), k.alias("k"))
    return e.withColumns({"spread": F.col("mid") * (1 + F.col("k")) * 1.23456789e-5, "flags": (2 + 2 * (F.col("k") % 3)).cast("bigint")})


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quotes(spark, sf_dir)
    return q.select("id", "symbol", "ts", "flags", F.when(F.col("flags") != 4, F.col("mid") - F.col("spread") / 2).alias("bid"), F.when(F.col("flags") != 2, F.col("mid") + F.col("spread") / 2).alias("ask"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.operators.bars import bars

    return bars(quotes(spark, sf_dir), "hour")


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.operators.indicators import log_ret

    return log_ret(hourly(spark, sf_dir)).withColumnRenamed("ret_1", "ret")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    q = quotes(spark, sf_dir)
    ahead = F.lead("mid").over(Window.partitionBy("symbol").orderBy("ts", "id"))
    return q.select("id", "symbol", F.col("ts").alias("dt"), (F.col("k") / 100).alias("p"), F.when(ahead > F.col("mid"), 1).otherwise(0).alias("y"), log_ratio(ahead, F.col("mid")).alias("fwd"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    pnl = F.col("l_extendedprice") * (F.col("l_tax") - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select(pnl.alias("pnl"), F.col("l_returnflag").alias("reason"), F.col("l_quantity").alias("size"), F.col("l_shipdate").alias("day"), "l_orderkey", "l_linenumber")
