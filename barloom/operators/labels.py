"""Forward labels and walk-forward folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import clip, log_ratio, spread_cost
from barloom.operators.indicators import TRADE_SESSIONS, islands


def by_time() -> Window:
    """A symbol's rows in time order."""
    return Window.partitionBy("symbol").orderBy("dt")


def label_next_bar(b: DataFrame) -> DataFrame:
    """1 if the next close is higher, 0 if not, null on the last row."""
    return b.withColumn("label", (F.lead("c").over(by_time()) > F.col("c")).cast("int"))


def forward_return(b: DataFrame, dead: float = 1e-4) -> DataFrame:
    """fwd = ln(next c / c) and its class: 2 above the dead zone, 0 below, 1 within."""
    b = b.withColumn("fwd", log_ratio(F.lead("c").over(by_time()), F.col("c")))
    return b.withColumn("fwd_class", F.when(F.col("fwd") > dead, 2).when(F.col("fwd") < -dead, 0).when(F.col("fwd").isNotNull(), 1))


def label_threshold(b: DataFrame, h: int, threshold: float) -> DataFrame:
    """Sum of the next h returns, less the spread's cost, against +-threshold: 2 buy, 0 sell, 1 hold; rows without h rows ahead hold."""
    b = b.withColumn("__r", F.coalesce(log_ratio(F.col("c"), F.lag("c").over(by_time())), F.lit(0.0)))
    ahead = by_time().rowsBetween(1, h)
    total = F.when(F.count("*").over(ahead) == h, F.sum("__r").over(ahead))
    b = b.withColumn("fwd_sum", total)
    cost = F.coalesce(F.try_divide(F.col("sp"), F.col("c")), F.lit(0.0))
    return b.withColumn("label", F.when(F.col("fwd_sum") - cost > threshold, 2).when(F.col("fwd_sum") + cost < -threshold, 0).otherwise(1)).drop("__r")


def label_quantile(b: DataFrame, horizon: int, buy_percent: int = 30, sell_percent: int = 30, real: str | None = None) -> DataFrame:
    """Rank labels by the sum of the next `horizon` returns: the lowest and highest floor(n * percent / 100) rows sell (0) and buy (2), the rest hold (1).

    n counts a symbol's rows that have so many after them and are real; others
    hold. Ties are in order of dt.
    """
    t = by_time()
    b = b.withColumn("__r", F.coalesce(log_ratio(F.col("c"), F.lag("c").over(t)), F.lit(0.0)))
    ahead = t.rowsBetween(1, horizon)
    b = b.withColumn("fwd", F.when(F.count("*").over(ahead) == horizon, F.sum("__r").over(ahead)))
    b = b.withColumn("__able", F.col("fwd").isNotNull() & (F.coalesce(F.col(real), F.lit(False)) if real else F.lit(True)))
    w = Window.partitionBy("symbol", "__able")
    b = b.withColumns({"__rn": F.row_number().over(w.orderBy("fwd", "dt")), "__n": F.count("*").over(w)})
    low, high = F.floor(F.col("__n") * sell_percent / 100), F.floor(F.col("__n") * buy_percent / 100)
    label = F.when(~F.col("__able"), 1).when(F.col("__rn") > F.col("__n") - high, 2).when(F.col("__rn") <= low, 0).otherwise(1)
    return b.withColumn("label", label).drop("__r", "__able", "__rn", "__n")


def label_triple_barrier(b: DataFrame, horizon: int, atr: str, pip: Column, spread_share: float = 2.0, atr_share: float = 0.35, start: int = 14, binary: bool = True) -> DataFrame:
    """First touch of +-max(spread_share * spread cost, atr_share * atr) within horizon rows: 1 up, -1 down, 0 none.

    Both in one row: up if its close is not below the entry. barrier_valid from
    row `start` on, where horizon rows follow and ATR is known; the binary form
    takes no row without a touch.
    """
    barrier = F.greatest(spread_share * spread_cost(F.col("sp"), F.col("c"), pip), atr_share * F.col(atr))
    ahead = F.collect_list(F.struct("h", "l", "c")).over(by_time().rowsBetween(1, horizon))
    b = b.withColumns({"barrier": barrier, "__a": ahead, "__rn": F.row_number().over(by_time()) - 1})
    up, down = F.col("c") + F.col("barrier"), F.col("c") - F.col("barrier")

    def touch(x: Column) -> Column:
        hi, lo = x["h"] >= up, x["l"] <= down
        return F.when(hi & lo, F.when(x["c"] >= F.col("c"), 1.0).otherwise(-1.0)).when(hi, 1.0).when(lo, -1.0).otherwise(0.0)

    first = F.aggregate("__a", F.lit(0.0), lambda s, x: F.when(s != 0, s).otherwise(touch(x)))
    b = b.withColumn("label", F.when(F.col("barrier").isNotNull(), first).cast("int"))
    valid = (F.col("__rn") >= start) & (F.size("__a") == horizon) & F.col(atr).isNotNull()
    return b.withColumn("barrier_valid", valid & (F.col("label") != 0) if binary else valid).drop("__a", "__rn")


def label_smooth(y: Column, eps: float) -> Column:
    return y * (1 - eps) + eps / 2


def entry_quality(b: DataFrame, session: str, label: str, k: int = 3) -> DataFrame:
    """b with spread_quality, entry_score and ready: how good a scalp entry a bar is for its labelled direction (1 up, else down).

    The score weighs momentum .4, breakout of the session run's opening range
    .25, volatility near its mean .2, spread .1 and ticks .05, each within
    [0, 1]. ready: a trade session whose run has had k bars. Needs real and
    the columns of a bar.
    """
    t, rows = by_time(), lambda n: by_time().rowsBetween(1 - n, 0)
    b = islands(b, session)
    run = Window.partitionBy("symbol", "island")
    b = b.withColumn("__c", F.greatest(F.col("c"), F.lit(1e-6)))
    b = b.withColumns({"__rn": F.row_number().over(t), "__r": F.coalesce(log_ratio(F.col("__c"), F.lag("__c").over(t)), F.lit(0.0)), "__n": F.row_number().over(run.orderBy("dt")), "__real": F.sum(F.col("real").cast("int")).over(run.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0))})
    first = F.col("real") & (F.col("__real") <= k)
    b = b.withColumns({"__hi": F.max(F.when(first, F.col("h"))).over(run), "__lo": F.min(F.when(first, F.col("l"))).over(run), "__top": F.max(F.when(first, F.col("c"))).over(run), "__k": F.max("__real").over(run)})
    trade = F.col(session).isin(*TRADE_SESSIONS)
    width = F.greatest(F.col("__hi") - F.col("__lo"), F.greatest("__top", F.lit(1e-6)) * 1e-6)
    from_ = lambda n, x: F.when(F.col("__rn") >= n, x).otherwise(0.0)
    rms = lambda n: F.sqrt(F.avg(F.col("__r") * F.col("__r")).over(rows(n)))
    b = b.withColumns({
        "__break": F.when(trade & (F.col("__k") >= k), (F.col("c") - (F.col("__hi") + F.col("__lo")) / 2) / width).otherwise(0.0), "__m3": from_(2, F.sum("__r").over(rows(3))), "__m6": from_(3, F.sum("__r").over(rows(6))),
        "__v6": from_(3, rms(6)), "__v12": from_(6, rms(12)), "__tm": from_(3, F.avg("tk").over(rows(12))), "__td": from_(3, F.stddev_pop("tk").over(rows(12))),
    })
    ratio = F.when(F.col("__v12") > 1e-8, F.col("__v6") / F.greatest("__v12", F.lit(1e-8))).otherwise(0.0)
    shock = F.when(F.col("__td") > 1e-6, (F.col("tk") - F.col("__tm")) / F.greatest("__td", F.lit(1e-6))).otherwise(0.0)
    side = F.when(F.col(label) > 0.5, 1.0).otherwise(-1.0)
    stress = F.col("sp") / F.col("__c") / F.greatest("__v6", "__v12", F.lit(5e-5))
    parts = {
        "spread_quality": clip(1 - stress / 5, 0.0, 1.0), "__tick": clip(0.5 + 0.25 * shock, 0.0, 1.0), "__mid": F.exp(-F.abs(F.log(clip(ratio, 1e-3, 10.0)))),
        "__move": clip((side * (0.65 * F.col("__m3") + 0.35 * F.col("__m6")) / F.greatest("__v12", F.lit(1e-6)) + 0.05) / 0.55, 0.0, 1.0), "__out": clip((side * F.col("__break") + 0.1) / 0.6, 0.0, 1.0),
    }
    b = b.withColumns(parts).withColumn("ready", trade & (F.col("__n") >= k))
    b = b.withColumn("entry_score", 0.4 * F.col("__move") + 0.25 * F.col("__out") + 0.2 * F.col("__mid") + 0.1 * F.col("spread_quality") + 0.05 * F.col("__tick"))
    return b.drop(*(x for x in b.columns if x.startswith("__")), "island")


def label_entry(b: DataFrame) -> DataFrame:
    """b, of entry_quality() with barrier_valid and real, with entry: 1 on ready real bars of score .48 and spread quality .2 at least."""
    good = F.col("barrier_valid") & F.col("real") & F.col("ready") & (F.col("spread_quality") >= 0.2) & (F.col("entry_score") >= 0.48)
    return b.withColumn("entry", F.coalesce(good, F.lit(False)).cast("int"))


def valid_rows(b: DataFrame, warm_up: int = 32, tail: int = 6) -> DataFrame:
    """Real rows after warm_up rows and as many real ones so far, and before the last `tail`."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    real = F.sum(F.col("real").cast("int")).over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    b = b.withColumns({"__rn": F.row_number().over(by_time()) - 1, "__n": n, "__real": real})
    return b.where(F.col("real") & (F.col("__rn") >= warm_up) & (F.col("__rn") < F.col("__n") - tail) & (F.col("__real") >= warm_up)).drop("__rn", "__n", "__real")


def folds_by_block(b: DataFrame, block: Column, holdout: int = 1, purge: int = 6, least: int = 2) -> DataFrame:
    """(fold, symbol, dt, part): expanding folds over blocks of time.

    Fold k trains on the first `least` + k blocks and validates on the next; the
    last `holdout` blocks are every fold's holdout. The last `purge` bars of
    training are left out. Blocks are numbered on the list of distinct times, which is small.
    """
    times = b.select("dt", block.alias("__b")).distinct()
    numbered = times.select("dt", (F.dense_rank().over(Window.orderBy("__b")) - 1).alias("blk"), F.row_number().over(Window.orderBy("dt")).alias("bar"))
    ends = numbered.groupBy("blk").agg(F.max("bar").alias("end"))
    last = numbered.agg((F.max("blk") - holdout).alias("last"))
    folds = ends.join(F.broadcast(last)).where(f"blk < last and blk >= {least - 1}").select((F.col("blk") - (least - 1)).alias("fold"), F.col("end").alias("train_end"), "last")
    parts = numbered.join(F.broadcast(folds), (F.col("blk") <= F.col("fold") + least) | (F.col("blk") > F.col("last")))
    part = F.when(F.col("blk") > F.col("last"), "holdout").when(F.col("blk") == F.col("fold") + least, "valid").when(F.col("bar") <= F.col("train_end") - purge, "train")
    return b.select("symbol", "dt").join(parts.select("dt", "fold", part.alias("part")).where("part is not null"), "dt").select("fold", "symbol", "dt", "part")


def folds_walkforward(b: DataFrame, unit: str = "week", holdout: int = 1, purge: int = 6, least: int = 2) -> DataFrame:
    return folds_by_block(b, F.date_trunc(unit, F.col("dt")), holdout, purge, least)


def folds_expanding(b: DataFrame, block: Column, min_train: int = 1, purge: int = 5) -> DataFrame:
    """(fold, symbol, dt, part): fold k trains on the first min_train + k blocks and validates on the next.

    block is null for rows of no fold, such as a holdout's. The `purge` times
    before a validation's first one are not trained on. Blocks are numbered on
    the list of distinct times, which is small.
    """
    times = b.select("dt", block.alias("__b")).distinct().withColumn("bar", F.row_number().over(Window.orderBy("dt")))
    used = times.where("__b is not null").withColumn("blk", F.dense_rank().over(Window.orderBy("__b")) - 1)
    starts = used.groupBy("blk").agg(F.min("bar").alias("start")).where(F.col("blk") >= min_train).withColumn("fold", F.col("blk") - min_train)
    parts = used.select("dt", "bar", F.col("blk").alias("own")).join(starts, F.col("own") <= F.col("blk"))
    part = F.when(F.col("own") == F.col("blk"), "valid").when((F.col("bar") < F.col("start") - purge) | (F.col("bar") >= F.col("start")), "train")
    return b.select("symbol", "dt").join(parts.select("dt", "fold", part.alias("part")).where("part is not null"), "dt").select("fold", "symbol", "dt", "part")


def overlap_blocks(b: DataFrame, session: Column, days: int, overlap: int = 4) -> DataFrame:
    """b with block: the number of its day's group of so many days that have an overlap session; null on other days. Days without any overlap at all count by themselves."""
    day = F.date_trunc("day", F.col("dt"))
    per = b.groupBy(day.alias("__day")).agg(F.bool_or(session == overlap).alias("__o"))
    any_ = per.agg(F.bool_or("__o").alias("__any"))
    chosen = per.join(F.broadcast(any_)).where("__o or not __any")
    numbered = chosen.select("__day", F.floor((F.row_number().over(Window.orderBy("__day")) - 1) / days).alias("block"))
    return b.withColumn("__day", day).join(numbered, "__day", "left").drop("__day")


def folds_metadata(folds: DataFrame) -> DataFrame:
    """(fold, part, first, last, times) of each fold's parts."""
    return folds.groupBy("fold", "part").agg(F.min("dt").alias("first"), F.max("dt").alias("last"), F.count_distinct("dt").alias("times"))


def folds_timeseries(b: DataFrame, k: int = 4, purge: int = 5) -> DataFrame:
    """k expanding folds of n / (k + 1) distinct times each."""
    t = b.select("dt").distinct()
    n = t.agg(F.floor(F.count("*") / (k + 1)).alias("size"))
    numbered = t.withColumn("bar", F.row_number().over(Window.orderBy("dt")) - 1).join(F.broadcast(n)).withColumn("blk", F.floor(F.col("bar") / F.col("size")))
    f = numbered.select("dt", "bar", "blk", "size", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("fold"))
    part = F.when(F.col("blk") == F.col("fold"), "valid").when(F.col("bar") < F.col("fold") * F.col("size") - purge, "train")
    return b.select("symbol", "dt").join(f.select("fold", "dt", part.alias("part")).where("part is not null"), "dt").select("fold", "symbol", "dt", "part")


def train_only_scaler(rows: DataFrame, folds: DataFrame, column: str) -> DataFrame:
    """Each fold's rows scaled by the mean and deviation of its own training rows."""
    j = rows.join(folds, ["symbol", "dt"])
    stats = j.where("part = 'train'").groupBy("fold").agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
    return j.join(F.broadcast(stats), "fold").withColumn("scaled", (F.col(column) - F.col("mean")) / (F.col("std") + 1e-10)).drop("mean", "std")
