"""Queries of readers and writers: bars and ticks are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import calendar
from barloom.operators import indicators as ind
from barloom.plans.indicator_queries import KEY, SQL
from barloom.plans.registry import hourly, query, quotes, ticks
from barloom.plans.stream_queries import shared_folder
from barloom.sources import readers, writers

BAR = f"{KEY} o:d h:d l:d c:d sp:d tk:i"
NAMES = {"dt": "bar_time", "o": "open", "h": "high", "l": "low", "c": "close", "tk": "tick_volume", "sp": "spread"}
STAMP = "yyyy.MM.dd HH:mm:ss"


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True)


def _stamped(b: DataFrame) -> DataFrame:
    return b.withColumn("dt", F.date_format("dt", STAMP))


@query("scan_ticks", "symbol:s ts:t bid:d ask:d flags:i", "SELECT upper(symbol) AS symbol, date_trunc('milliseconds', ts) AS ts, bid, ask, flags FROM ticks")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Comma and tab dialects, a folder a symbol."""
    t, base = ticks(spark, d), _place(spark, "ticks")
    form = t.select("symbol", F.date_format("ts", "yyyy.MM.dd").alias("<DATE>"), F.date_format("ts", "HH:mm:ss.SSS").alias("<TIME>"), F.col("bid").alias("<BID>"), F.col("ask").alias("<ASK>"), F.lit("").alias("<LAST>"), F.lit(0).alias("<VOLUME>"), F.col("flags").alias("<FLAGS>"))
    form.where("symbol < 'p'").write.partitionBy("symbol").csv(f"{base}/comma", header=True)
    form.where("symbol >= 'p'").write.partitionBy("symbol").csv(f"{base}/tab", header=True, sep="\t")
    return readers.scan_ticks(spark, f"{base}/comma").unionByName(readers.scan_ticks(spark, f"{base}/tab", sep="\t"))


@query("scan_candles", f"{KEY} o:d h:d l:d c:d sp:d tk:i", "SELECT upper(symbol) AS symbol, dt, o, h, l, c, sp, tk FROM bars")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Files whose columns stand in another order and have other names lie in one folder."""
    b, base = _stamped(hourly(spark, d)), _place(spark, "candles")
    for i, (rows, order) in enumerate(((b.where("symbol < 'p'"), ["dt", "o", "h", "l", "c", "tk", "sp"]), (b.where("symbol >= 'p'"), ["tk", "c", "l", "h", "o", "sp", "dt"]))):
        rows.select("symbol", *(F.col(c).alias(NAMES[c] if i else f"<{NAMES[c].upper()}>") for c in order)).write.mode("append").partitionBy("symbol").csv(base, header=True)
    c = readers.scan_candles(spark, base)
    return c.withColumn("symbol", readers.symbol_of(F.col("file")))


@query("scan_partitioned_tree", f"{KEY} tf:s year:i quarter:s c:d tk:i", "SELECT CASE symbol WHEN 'view' THEN 'VIEW.x' ELSE symbol END AS symbol, dt, 'H1' AS tf, year(dt) AS year, 'Q' || quarter(dt) AS quarter, c, tk FROM bars WHERE dt >= TIMESTAMP '2024-01-05' AND dt <= TIMESTAMP '2024-01-20 23:59:59'")
def _(spark: SparkSession, d: str) -> DataFrame:
    b, root = hourly(spark, d), _place(spark, "tree")
    for r in b.select("symbol", F.year("dt").alias("y"), F.quarter("dt").alias("q")).distinct().collect():  # folders of a dimension: symbols and quarters
        mine = b.where((F.col("symbol") == r["symbol"]) & (F.year("dt") == r["y"]) & (F.quarter("dt") == r["q"]))
        _csv(_stamped(mine).select(*(F.col(c).alias(n) for c, n in NAMES.items())), f"{root}/{r['y']}/Q{r['q']}/{r['symbol']}/candles_H1.csv")
    alias = spark.createDataFrame([("view", "VIEW.x")], "alias string, symbol string")
    return readers.scan_partitioned_tree(spark, root, alias, "2024-01-05", "2024-01-20")


@query("scan_micro_bars", BAR, "SELECT symbol, date_trunc('second', ts) AS dt, arg_min(mid, id) AS o, max(mid) AS h, min(mid) AS l, arg_max(mid, id) AS c, avg(spread) AS sp, count(*) AS tk FROM quotes GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    from barloom.operators.bars import bars_1s

    b, path = bars_1s(quotes(spark, d)).select("symbol", "dt", "o", "h", "l", "c", "sp", "tk"), _place(spark, "micro")
    half = F.date_trunc("day", "dt") < F.lit("2024-01-16").cast("timestamp_ntz")
    named = _stamped(b).select("symbol", *(F.col(c).alias(n) for c, n in NAMES.items()))
    _csv(named.where(F.col("bar_time") < "2024.01.16"), f"{path}/csv")
    again = b.where(~half)
    again.unionByName(again).write.parquet(f"{path}/parquet")
    return readers.scan_micro_bars(spark, f"{path}/csv", "csv").unionByName(readers.scan_micro_bars(spark, f"{path}/parquet"))


@query("scan_json_bars", BAR, "SELECT symbol, dt, round(o, 6) AS o, round(h, 6) AS h, round(l, 6) AS l, round(c, 6) AS c, round(sp, 6) AS sp, tk FROM bars")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "json")
    writers.bars_as_json(hourly(spark, d)).select(F.concat(F.lit('{"'), "symbol", F.lit('":'), "bars", F.lit("}"))).write.option("maxRecordsPerFile", 1).text(path)
    return readers.scan_json_bars(spark, path)


@query("sink_parquet", BAR, "SELECT symbol, dt, o, h, l, c, sp, tk FROM bars")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "bars")
    writers.sink_parquet(hourly(spark, d), path)
    return spark.read.parquet(path)


@query("sink_json", "symbol:s n:i c_sum:d", "SELECT symbol, count(*) AS n, sum(round(c, 6)) AS c_sum FROM bars GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "json")
    writers.sink_json(hourly(spark, d), path)
    bars = F.from_json("value", "array<struct<dt:string,c:double>>")
    return spark.read.text(path).select("symbol", F.explode(bars).alias("b")).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("b.c").alias("c_sum"))


@query("sink_quarterly_upsert", f"{KEY} c:d year:i quarter:i", "SELECT symbol, dt, CASE WHEN dt >= TIMESTAMP '2024-01-15' THEN c * 2 ELSE c END AS c, year(dt) AS year, quarter(dt) AS quarter FROM bars")
def _(spark: SparkSession, d: str) -> DataFrame:
    b, path = hourly(spark, d).select("symbol", "dt", "c"), _place(spark, "upsert")
    writers.sink_quarterly_upsert(spark, b, path)
    writers.sink_quarterly_upsert(spark, b.where("dt >= TIMESTAMP_NTZ '2024-01-15 00:00:00'").withColumn("c", F.col("c") * 2), path)
    return spark.read.parquet(path)


@query("sink_feature_tables", "tf:s rows:i first:t last:t", "SELECT CASE WHEN tk % 2 = 0 THEN 'A' ELSE 'B' END AS tf, count(*) AS rows, min(dt) AS first, max(dt) AS last FROM bars GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return writers.sink_feature_tables(hourly(spark, d).withColumn("tf", F.when(F.col("tk") % 2 == 0, "A").otherwise("B")), _place(spark, "features"))


@query("export_feature_pack", f"{KEY} tf:s o:d h:d l:d c:d sp:d tk:d validity:d session_code:d session_transition:d regime_signal:d", f"SELECT b.symbol, b.dt, 'H1' AS tf, o, h, l, c, sp, tk, (tk > 1)::INT AS validity, s.session_code / 4.0 AS session_code, m.moved::INT AS session_transition, CASE WHEN tk > 1 THEN trend_regime ELSE 0 END AS regime_signal FROM bars b JOIN ({SQL['session_code']}) s USING (symbol, dt) JOIN ({SQL['session_transition']}) m USING (symbol, dt) JOIN ({SQL['trend_regime']}) t USING (symbol, dt)")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = ind.trend_regime(hourly(spark, d)).withColumns({"session": calendar.session_code(F.col("dt")), "real": F.col("tk") > 1, "tf": F.lit("H1")})
    return writers.export_feature_pack(ind.changes(b, "session", "moved").withColumnRenamed("trend_regime", "trend"), _place(spark, "pack"))


@query("union_files", "symbol:s ts:t mid:d", "SELECT DISTINCT ON (symbol, ts) symbol, ts, mid FROM quotes")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping files of one schema, read as one and freed of repeated rows."""
    q, path = quotes(spark, d).select("symbol", "ts", "mid"), _place(spark, "files")
    q.where("mid > 20").write.parquet(f"{path}/a")
    q.where("mid <= 60").write.parquet(f"{path}/b")
    return spark.read.parquet(f"{path}/a", f"{path}/b").dropDuplicates(["symbol", "ts"])
