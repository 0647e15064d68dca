"""Streaming queries: the events table read as a stream and run to its end into Parquet."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import calendar
from barloom.functions.numeric import pip_size
from barloom.operators.indicators import PAIR_FEATURES
from barloom.plans.indicator_queries import SESSION
from barloom.plans.registry import SQL, hourly, query, quotes, scored, table, ticks
from barloom.streaming import streams

#: Rows of a source file that a stream with an aggregation reads.
FILE_ROWS = 1_000_000
#: Rows of a micro-batch of a stream that puts a symbol's rows in order in memory.
SLICE_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local runs a folder of our own where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or tempfile.mkdtemp(prefix="barloom-")).rstrip("/")


def drained(spark: SparkSession, rows: DataFrame, stream_of, at: str | None = None) -> DataFrame:
    """Write rows as a replayable source, run stream_of(source) over all of it, and return what it wrote."""
    return drained_counted(spark, rows, stream_of, at=at)[0]


def in_slices(spark: SparkSession, rows: DataFrame, base: str, at: str) -> int:
    """Write rows to base/in as files of about SLICE_ROWS rows, one after the other in the order of `at`; returns how many.

    A stream takes files by their time of writing. Rows of equal `at` share a file.
    """
    n = max(1, -(-rows.count() // SLICE_ROWS))
    cut = rows.repartitionByRange(n, F.col(at).asc_nulls_last()).withColumn("__slice", F.spark_partition_id())
    cut.write.partitionBy("__slice").parquet(f"{base}/cut")
    written = spark.read.schema(cut.schema).parquet(f"{base}/cut")
    for k in range(n):
        written.where(F.col("__slice") == k).select(*rows.columns).coalesce(1).write.mode("append").parquet(f"{base}/in")
    return n


def drained_counted(spark: SparkSession, rows: DataFrame, stream_of, files_per_trigger: int = 1_000_000, at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What stream_of() wrote, and how many rows came too late in each micro-batch.

    With `at`, a column of time, micro-batches follow it and have about
    SLICE_ROWS rows each, however many there are: for states that put a
    symbol's rows of a micro-batch in order in memory.
    """
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if at:
        in_slices(spark, rows, base, at)
        files_per_trigger = 1
    else:
        rows.write.parquet(f"{base}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{base}/in")
    out = stream_of(source)
    with streams.with_rocksdb(spark):
        q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out"), streams.late_rows(q)


def late_of(spark: SparkSession, parts: list[DataFrame], stream_of) -> DataFrame:
    """streams.late_rows() of a stream that is started again, from its checkpoint, after each part has been written to its source.

    A part is one micro-batch of files of bounded rows, so no task holds it whole.
    """
    base, found = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}", None
    for rows in parts:
        rows.repartition(max(1, -(-rows.count() // FILE_ROWS)), *rows.columns).write.mode("append").parquet(f"{base}/in")
        out = stream_of(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
        run = out.writeStream.format("noop").option("checkpointLocation", f"{base}/check").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
        one = streams.late_rows(run)
        found = one if found is None else found.unionByName(one)
    return found


def _ntz(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in columns})


@query("stream_bars", "symbol:s dt:t o:d h:d l:d c:d tk:i", "SELECT symbol, dt, o, h, l, c, tk FROM bars WHERE dt + INTERVAL 2 HOUR <= (SELECT max(ts) FROM quotes)")
def _(spark: SparkSession, d: str) -> DataFrame:
    q = _ntz(quotes(spark, d).select("symbol", "ts", "id", "mid"), "ts")
    return drained(spark, q, streams.stream_bars).withColumn("dt", F.col("dt").cast("timestamp_ntz"))


@query("stream_dedupe", "symbol:s ts:t", "SELECT DISTINCT symbol, ts FROM quotes")
def _(spark: SparkSession, d: str) -> DataFrame:
    q = _ntz(quotes(spark, d).select("symbol", "ts"), "ts")
    return drained(spark, q.unionByName(q.where(F.second("ts") % 2 == 0)), streams.stream_dedupe).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_tick_ffill", "id:i symbol:s bid:d ask:d", "SELECT id, symbol, last_value(bid IGNORE NULLS) OVER w AS bid, last_value(ask IGNORE NULLS) OVER w AS ask FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, id ROWS UNBOUNDED PRECEDING)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return drained(spark, _ntz(ticks(spark, d).select("symbol", "ts", "id", "bid", "ask"), "ts"), streams.stream_tick_ffill, "ts")


@query("stream_hysteresis", "symbol:s dt:t position:i")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _ntz(scored(spark, d).select("symbol", "dt", F.col("p").alias("p_buy"), (1 - F.col("p")).alias("p_sell")), "dt")
    return drained(spark, s, streams.stream_hysteresis, "dt").withColumn("dt", F.col("dt").cast("timestamp_ntz"))


#: Every symbol at every hour that any has, up to an hour before the last; missing bars at the last close.
PANEL = """
  SELECT symbol, dt, coalesce(o, held) AS o, coalesce(h, held) AS h, coalesce(l, held) AS l, held AS c, coalesce(sp, 0) AS sp, coalesce(tk, 0) AS tk
  FROM (
    SELECT s.symbol, t.dt, b.o, b.h, b.l, b.sp, b.tk, last_value(b.c IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY t.dt ROWS UNBOUNDED PRECEDING) AS held
    FROM (SELECT DISTINCT symbol FROM bars) AS s CROSS JOIN (SELECT DISTINCT dt FROM bars) AS t LEFT JOIN bars AS b ON b.symbol = s.symbol AND b.dt = t.dt
    WHERE t.dt <= (SELECT max(dt) FROM bars) - INTERVAL 1 HOUR)
  WHERE held IS NOT NULL"""


@query(
    "stream_indicators",
    " ".join(["symbol:s dt:t", *(f"{c}:d" for c in PAIR_FEATURES)]),
    f"""SELECT * FROM (WITH panel AS ({PANEL}) {re.sub(r"\bbars\b", "panel", SQL["pair_features_16"])})
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dt) >= 200""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    b = _ntz(hourly(spark, d).select("symbol", "dt", "o", "h", "l", "c", "sp", "tk"), "dt")
    symbols = sorted(r["symbol"] for r in table(spark, d, "events").select(F.col("event_type").alias("symbol")).distinct().collect())
    live = drained(spark, b, lambda s: streams.stream_indicators(streams.on_timeline(s, symbols), pip_size(F.col("symbol"))), "dt")
    return live.withColumn("dt", F.col("dt").cast("timestamp_ntz"))


@query("stream_session", "symbol:s dt:t session:i bars_in_run:i", f"SELECT symbol, dt, s AS session, row_number() OVER (PARTITION BY symbol, island ORDER BY dt) AS bars_in_run FROM (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN s <> lag(s) OVER (PARTITION BY symbol ORDER BY dt) THEN 1 ELSE 0 END AS ch FROM (SELECT *, {SESSION.format('dt')} AS s FROM bars)))")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = _ntz(hourly(spark, d).select("symbol", "dt", calendar.session_code(F.col("dt")).alias("session"), "h", "l"), "dt")
    return drained(spark, b, streams.stream_session, "dt").withColumn("dt", F.col("dt").cast("timestamp_ntz"))


@query("stream_late_rows", "dropped:i", "WITH m AS (SELECT max(ts) AS top FROM quotes) SELECT count(DISTINCT (symbol, date_trunc('hour', ts))) AS dropped FROM quotes, m WHERE id % 50 = 0 AND ts < top - INTERVAL 2 HOUR")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every quote, the last one again, then each fiftieth again: by the third start the watermark has passed all but the last hours.

    The aggregation drops what reaches it, a row a symbol and hour.
    """
    q = _ntz(quotes(spark, d).select("symbol", "ts", "id", "mid"), "ts")
    joined = q.join(F.broadcast(q.agg(F.max("ts").alias("top"))))
    late = joined.where("id % 50 = 0 and ts < top - INTERVAL 2 HOURS").drop("top")
    return late_of(spark, [q, joined.where("ts = top").drop("top"), late], streams.stream_bars).agg(F.sum("dropped").alias("dropped"))
