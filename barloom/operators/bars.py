"""Ticks to bars, and bars to coarser bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.carry import carry


def tick_ffill(ticks: DataFrame) -> DataFrame:
    """Last known bid and ask of each symbol at each tick, in order of (ts, id)."""
    return carry(ticks, [F.col("ts"), F.col("id")], past={c: F.col(c) for c in ("bid", "ask")}, time="ts")


def drop_unquoted(ticks: DataFrame) -> DataFrame:
    """Ticks from the first at which both sides are known."""
    return ticks.where("bid is not null and ask is not null")


def mid_spread(ticks: DataFrame) -> DataFrame:
    return ticks.withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "spread": F.col("ask") - F.col("bid")})


def date_range_filter(df: DataFrame, start: str, end: str, column: str = "ts") -> DataFrame:
    """Rows from start to the last millisecond of the day end, both inclusive."""
    return df.where(F.col(column).between(F.lit(start).cast("timestamp_ntz"), F.lit(f"{end} 23:59:59.999").cast("timestamp_ntz")))


def flag_bits(ticks: DataFrame) -> DataFrame:
    """Whether a tick changed the bid (bit 2) and the ask (bit 4)."""
    return ticks.withColumns({"bid_tick": F.col("flags").bitwiseAND(2) > 0, "ask_tick": F.col("flags").bitwiseAND(4) > 0})


def floor_time(ts: Column, unit: str) -> Column:
    """Start of the bucket: a date_trunc unit, or an interval like '15 minutes'."""
    return (F.window(ts, unit)["start"] if " " in unit else F.date_trunc(unit, ts)).cast("timestamp_ntz")


def bars(ticks: DataFrame, unit: str = "hour") -> DataFrame:
    """Left-closed bars of mid: first, greatest, least, last, mean spread, ticks; buckets without ticks have no row.

    first/last follow (ts, id). Spark's partial aggregation merges pieces of a
    bar, so one pass over any split of the ticks is enough.
    """
    at = F.struct("ts", "id")
    return ticks.groupBy("symbol", floor_time(F.col("ts"), unit).alias("dt")).agg(
        F.min_by("mid", at).alias("o"), F.max("mid").alias("h"), F.min("mid").alias("l"), F.max_by("mid", at).alias("c"), F.avg("spread").alias("sp"), F.count("*").alias("tk")
    )


def bars_1s(ticks: DataFrame) -> DataFrame:
    """One-second bars with counts of bid and ask ticks."""
    at = F.struct("ts", "id")
    return flag_bits(ticks).groupBy("symbol", floor_time(F.col("ts"), "second").alias("dt")).agg(
        F.min_by("mid", at).alias("o"), F.max("mid").alias("h"), F.min("mid").alias("l"), F.max_by("mid", at).alias("c"), F.avg("spread").alias("sp"), F.count("*").alias("tk"),
        F.count_if("bid_tick").alias("bid_ticks"), F.count_if("ask_tick").alias("ask_ticks"),
    )


def bars_1m(ticks: DataFrame, instrument: DataFrame) -> DataFrame:
    """One-minute bars whose spread is in pips, rounded to 2 places; instrument: (symbol, pip)."""
    return bars(ticks, "minute").join(F.broadcast(instrument.select("symbol", "pip")), "symbol").withColumn("sp", F.round(F.try_divide(F.col("sp"), F.col("pip")), 2)).drop("pip")


def tick_path(ticks: DataFrame, unit: str = "hour") -> DataFrame:
    """(symbol, dt, path): the first price of a bar, each new high or low, and the last price."""
    t = ticks.withColumn("dt", floor_time(F.col("ts"), unit))
    w = Window.partitionBy("symbol", "dt").orderBy("ts", "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    marked = t.withColumns({"hi": F.max("mid").over(before), "lo": F.min("mid").over(before), "next": F.lead("mid").over(w)})
    keep = F.col("hi").isNull() | (F.col("mid") > F.col("hi")) | (F.col("mid") < F.col("lo")) | F.col("next").isNull()
    path = F.array_sort(F.collect_list(F.struct("ts", "id", "mid")))
    return marked.where(keep).groupBy("symbol", "dt").agg(F.transform(path, lambda x: x["mid"]).alias("path"))


_ROLLED = ["o", "h", "l", "c", "sp", "tk"]


def _rolled(b: DataFrame, bucket: Column) -> DataFrame:
    return b.groupBy("symbol", bucket.alias("bucket")).agg(
        F.min_by("o", "dt").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "dt").alias("c"), F.avg("sp").alias("sp"), F.sum("tk").alias("tk")
    ).withColumnRenamed("bucket", "dt")


def bars_rollup_left(b: DataFrame, unit: str) -> DataFrame:
    """Coarser bars, closed and labelled at the left."""
    return _rolled(b, floor_time(F.col("dt"), unit))


def bars_rollup_right(b: DataFrame, interval: str) -> DataFrame:
    """Coarser bars, closed and labelled at the right: a bar at a bucket's end belongs to it."""
    shifted = F.col("dt") - F.expr("INTERVAL 1 MICROSECOND")
    return _rolled(b, F.window(shifted, interval)["end"].cast("timestamp_ntz"))


def bars_multi_tf(ticks: DataFrame, units: list[str]) -> DataFrame:
    """Bars of several timeframes in one shuffle: each tick takes part once a timeframe."""
    starts = F.array(*(F.struct(F.lit(u).alias("tf"), floor_time(F.col("ts"), u).alias("dt")) for u in units))
    at = F.struct("ts", "id")
    return ticks.select("symbol", "ts", "id", "mid", "spread", F.explode(starts).alias("x")).groupBy("symbol", F.col("x.tf").alias("tf"), F.col("x.dt").alias("dt")).agg(
        F.min_by("mid", at).alias("o"), F.max("mid").alias("h"), F.min("mid").alias("l"), F.max_by("mid", at).alias("c"), F.avg("spread").alias("sp"), F.count("*").alias("tk")
    )


def median_gap(b: DataFrame) -> DataFrame:
    """(symbol, gap_s): median seconds between a symbol's bars."""
    w = Window.partitionBy("symbol").orderBy("dt")
    gap = b.select("symbol", F.timestamp_diff("SECOND", F.lag("dt").over(w), F.col("dt")).alias("gap"))
    return gap.where("gap is not null").groupBy("symbol").agg(F.percentile("gap", F.lit(0.5)).alias("gap_s"))


def dedupe_latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row of each key that comes last in order."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
