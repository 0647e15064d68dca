"""Scores of probabilities, signals, folds and ledgers, as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import clip, norm_cdf, norm_ppf
from barloom.operators.quantiles import exact_quantiles


def classification(scored: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """n, log_loss, brier and accuracy of binary probabilities."""
    q = clip(F.col(p), 1e-7, 1 - 1e-7)
    return scored.agg(
        F.count("*").alias("n"), F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))).alias("log_loss"),
        F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("double")).alias("accuracy"),
    )


def classification_of(scored: DataFrame, p: list[str], y: str = "y", bins: int = 10) -> DataFrame:
    """n, log_loss, brier (mean over classes), accuracy and ece of probabilities of several classes; y numbers them from 0.

    ece is by the greatest probability, the first at ties; a confidence of 1 is in the last bin. Two aggregations.
    """
    of = F.array(*(F.col(c).cast("double") for c in p))
    best = F.array_max(of)
    rows = scored.select(of.alias("p"), F.col(y).cast("int").alias("y"), best.alias("best"), (F.array_position(of, best) - 1 == F.col(y)).cast("double").alias("right"))
    square = F.aggregate(F.transform("p", lambda x, i: F.pow(x - (i == F.col("y")).cast("double"), 2)), F.lit(0.0), lambda a, x: a + x) / len(p)
    bin_ = F.least(F.floor(F.col("best") * bins), F.lit(bins - 1))
    per = rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum(-F.log(clip(F.get("p", F.col("y")), 1e-7, 1 - 1e-7))).alias("loss"), F.sum(square).alias("square"), F.sum("right").alias("right"), F.sum("best").alias("best"))
    total = F.nullif(F.sum("n"), F.lit(0))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("loss") / total).alias("log_loss"), (F.sum("square") / total).alias("brier"), (F.sum("right") / total).alias("accuracy"), (F.sum(F.abs(F.col("right") - F.col("best"))) / total).alias("ece"))


def calibration_curve(scored: DataFrame, bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """(bin, n, mean_p, rate); probability 1 is in the last bin."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def ece(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error: gaps of the bins, weighted by their rows."""
    c = calibration_curve(scored, bins)
    return c.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.nullif(F.sum("n"), F.lit(0))).alias("ece"))


def auc(scored: DataFrame, keys: list[str], p: str = "p", y: str = "y", order: str = "id", ties: str = "ordinal") -> DataFrame:
    """Rank-sum AUC a group of keys: ties by position (ordinal) or at their mean rank (average); null with one class only."""
    if ties == "average":  # counts of distinct values first: the window runs over those, not over rows
        per = scored.groupBy(*keys, p).agg(F.count_if(F.col(y) == 1).alias("n1"), F.count_if(F.col(y) == 0).alias("n0"))
        below = F.sum("n0").over(Window.partitionBy(*keys).orderBy(p).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n0") / 2
        won = per.withColumn("__won", F.col("n1") * below).groupBy(*keys).agg(F.sum("__won").alias("won"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        return won.select(*keys, F.try_divide(F.col("won"), F.col("n1") * F.col("n0")).alias("auc"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(p, order)).cast("double")
    r = scored.withColumn("__r", rank).groupBy(*keys).agg(F.sum(F.when(F.col(y) == 1, F.col("__r"))).alias("s"), F.count_if(F.col(y) == 1).alias("n1"), F.count_if(F.col(y) == 0).alias("n0"))
    return r.select(*keys, F.try_divide(F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n0")).alias("auc"))


def regression_metrics(rows: DataFrame, pred: str, y: str) -> DataFrame:
    """MAE, MSE, RMSE, R2 and the direction accuracy of the 30 % of rows predicted largest."""
    cut = exact_quantiles(rows.select(F.abs(pred).alias("p")), [], "p", [0.7]).select(F.col("q0").alias("__cut"))
    j = rows.join(F.broadcast(cut)).join(F.broadcast(rows.agg(F.avg(y).alias("__mean"))))
    e = F.col(pred) - F.col(y)
    out = j.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), (1 - F.try_divide(F.sum(e * e), F.sum(F.pow(F.col(y) - F.col("__mean"), 2)))).alias("r2"), F.avg(F.when(F.abs(pred) >= F.col("__cut"), (F.signum(pred) == F.signum(y)).cast("double"))).alias("top_accuracy"))
    return out.withColumn("rmse", F.sqrt("mse"))


def strategy_sharpe(rows: DataFrame, pnl: Column, periods: float) -> DataFrame:
    """(symbol, sharpe, n): mean over sample deviation times sqrt(periods); 0 when flat."""
    s = rows.withColumn("__x", pnl).groupBy("symbol").agg(F.avg("__x").alias("m"), F.stddev_samp("__x").alias("s"), F.count("__x").alias("n"))
    return s.select("symbol", F.coalesce(F.try_divide(F.col("m") * math.sqrt(periods), F.col("s")), F.lit(0.0)).alias("sharpe"), "n")


# Periods of a year of five-minute bars.
YEAR = 252.0 * 78.0


def kelly_stakes(
    rows: DataFrame, p: str, threshold: float = 0.08, payoff: float = 1.0, scale: float = 0.25, cap: float = 0.05, floor: float = 0.0,
    session: str | None = None, ready: str | None = None, momentum: str | None = None, momentum_floor: float = 0.0, vol_ratio: str | None = None, vol_floor: float = 0.0, vol_cap: float | None = None,
    breakout: str | None = None, breakout_floor: float = 0.0, hard: bool = False, neighbours: str | None = None, align_scale: float = 0.35, laggard: str | None = None, laggard_floor: float = 0.0, boost: float = 0.0, hard_neighbours: bool = False,
) -> DataFrame:
    """rows with side (+1, 0, -1) and stake: fractional Kelly of the side's chance, gated and softly scaled.

    A side is taken where p lies threshold away from .5. session and ready are
    boolean columns that close it. Momentum, volatility ratio and breakout, each
    against its floor (and the ratio's cap), give multipliers whose mean scales
    the stake; a breakout against the side closes it; hard lets each also close
    a side below its floor. neighbours' signed momentum scales by
    1 + align_scale * tanh, within [.5, 1.5]; laggard's score by .65 to 1, and
    with boost once more, capped. Columns left out have no effect.
    """
    prob = F.col(p)
    side = F.when(prob >= 0.5 + threshold, 1).when(prob <= 0.5 - threshold, -1).otherwise(0)
    for gate in (session, ready):
        if gate:
            side = F.when(F.coalesce(F.col(gate), F.lit(False)), side).otherwise(0)
    rows, soft = rows.withColumn("side", side), []
    s, ramp = F.col("side"), lambda x: clip(0.35 + 0.65 * clip(x, 0.0, 1.5), 0.25, 1.25)

    def scaled(name: str, x: Column) -> None:
        """A multiplier, 1 where no side is left at this point."""
        nonlocal rows
        rows = rows.withColumn(name, F.when(s != 0, x).otherwise(1.0))
        soft.append(F.col(name))

    def close(rows: DataFrame, keep: Column) -> DataFrame:
        return rows.withColumn("side", F.when(F.coalesce(keep, F.lit(False)), s).otherwise(0))

    if momentum and momentum_floor > 0:
        if hard:
            rows = close(rows, F.col(momentum) >= momentum_floor)
        scaled("__momentum", ramp(F.col(momentum) / max(momentum_floor, 1e-6)))
    if vol_ratio:
        v, within, least = F.col(vol_ratio), F.lit(True), F.lit(1.0)
        if vol_floor > 0:
            within, least = within & (v >= vol_floor), F.least(least, clip(v / max(vol_floor, 1e-6), 0.25, 1.0))
        if vol_cap is not None:
            within, least = within & (v <= vol_cap), F.least(least, clip(vol_cap / F.greatest(v, F.lit(1e-6)), 0.25, 1.0))
        if hard:
            rows = close(rows, within)
        scaled("__vol", least)
    if breakout and breakout_floor > 0:
        rows = rows.withColumn("__along", F.when(s > 0, F.col(breakout)).when(s < 0, -F.col(breakout)).otherwise(0.0))
        rows = close(rows, F.col("__along") > 0)
        if hard:
            rows = close(rows, F.col("__along") >= breakout_floor)
        scaled("__out", ramp(F.col("__along") / max(breakout_floor, 1e-6)))
    factor = sum(soft[1:], soft[0]) / len(soft) if soft else F.lit(1.0)
    if neighbours:
        if hard_neighbours:
            rows = close(rows, ((s > 0) & (F.col(neighbours) > 0)) | ((s < 0) & (F.col(neighbours) < 0)))
        factor = factor * F.when(s != 0, clip(1 + align_scale * F.tanh(s * F.col(neighbours)), 0.5, 1.5)).otherwise(1.0)
    if laggard:
        if laggard_floor > 0 and hard_neighbours:
            rows = close(rows, F.col(laggard) >= laggard_floor)
        ready_ = clip(F.col(laggard) / max(laggard_floor, 1e-6) if laggard_floor > 0 else F.col(laggard), 0.0, 1.0)
        factor = factor * F.when(s != 0, clip(0.65 + 0.35 * ready_, 0.5, 1.0)).otherwise(1.0)
    b = max(payoff, 1e-6)
    win = clip(F.when(s > 0, prob).otherwise(1 - prob), 0.0, 1.0)
    stake = clip((b * win - (1 - win)) / b * scale, floor, cap) * factor
    if laggard and boost > 0:
        stake = clip(stake * (1 + boost * clip(F.col(laggard), 0.0, 1.0)), floor, cap)
    return rows.withColumn("stake", F.when(s != 0, stake).otherwise(0.0)).drop("__momentum", "__vol", "__out", "__along")


def kelly_eval(staked: DataFrame, p: str, y: str, fwd: str) -> DataFrame:
    """One row on the rows with a side: yearly sharpe, trades, win rate, mean stake, how often p's side was y's, mean return.

    Population deviation; all 0 without trades, the sharpe also when returns do not vary.
    """
    t = staked.where(F.col("side") != 0).withColumn("__x", F.col("side") * F.col(fwd) * F.col("stake"))
    m = t.agg(
        F.avg("__x").alias("mean_return"), F.stddev_pop("__x").alias("__s"), F.count("*").alias("trades"), F.avg((F.col("__x") > 0).cast("double")).alias("win_rate"), F.avg("stake").alias("mean_stake"),
        F.avg(((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("double")).alias("hit_rate"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sharpe = F.when(F.col("__s") >= 1e-8, F.col("mean_return") / F.col("__s") * math.sqrt(YEAR))
    return m.select(zero(sharpe).alias("sharpe"), "trades", *(zero(F.col(c)).alias(c) for c in ("win_rate", "mean_stake", "hit_rate", "mean_return")))


def param_grid(rows: DataFrame, grid: DataFrame, p: str, fwd: str, k: int) -> DataFrame:
    """The k best of a small table of settings (cfg, entry, payoff) scored on all rows; the grid is broadcast.

    A setting with fewer than ten trades, or more than half a trade a row, loses a point.
    """
    j = rows.join(F.broadcast(grid)).withColumn("pnl", F.when(F.col(p) >= F.col("entry"), F.col(fwd)).when(F.col(p) <= 1 - F.col("entry"), -F.col(fwd)))
    s = j.groupBy("cfg", "entry").agg(F.count("pnl").alias("trades"), F.count("*").alias("bars"), F.try_divide(F.avg("pnl"), F.stddev_samp("pnl")).alias("raw"))
    loses = (F.col("trades") < 10) | (F.col("trades") > 0.5 * F.col("bars"))
    score = F.coalesce(F.col("raw"), F.lit(0.0)) - F.when(loses, 1.0).otherwise(0.0)
    return s.withColumn("score", score).withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "cfg"))).where(F.col("rank") <= k).drop("raw", "bars")


def psr(sharpe: Column, n: Column, skew: Column, kurt: Column, target: Column, raw_kurtosis: bool = False) -> Column:
    """Probability that the Sharpe ratio exceeds the target; kurt is excess kurtosis, used as (kurt - 1) / 4 unless raw_kurtosis."""
    k = (kurt + 2) / 4 if raw_kurtosis else (kurt - 1) / 4
    var = 1 - skew * sharpe + k * sharpe * sharpe
    return F.when(n <= 1, 0.5).otherwise(norm_cdf((sharpe - target) * F.sqrt(n - 1) / F.sqrt(F.greatest(var, F.lit(1e-12)))))


def dsr(folds: DataFrame, sharpe: str = "score", bars: str = "n", target: float = 0.0) -> DataFrame:
    """(config, dsr) of folds (config, fold, sharpe, bars): the chance that the best fold's Sharpe ratio beats what so many trials reach without skill.

    That is the expected greatest of as many standard normal draws over the
    root of the mean number of bars (2 at least), or the target if it is more.
    """
    g = 0.5772156649
    s = folds.groupBy("config").agg(F.count("*").alias("trials"), F.greatest(F.avg(bars), F.lit(2.0)).alias("mean"), F.max(F.struct(F.col(sharpe), (-F.col("fold")).alias("f"), F.col(bars).alias("n"))).alias("best"))
    top = F.when(F.col("trials") == 1, 0.0).otherwise((1 - g) * norm_ppf(1 - 1 / F.col("trials")) + g * norm_ppf(1 - 1 / (F.col("trials") * math.e)))
    mark = F.greatest(F.lit(target), top / F.sqrt("mean"))
    return s.select("config", psr(F.col(f"best.{sharpe}"), F.col("best.n"), F.lit(0.0), F.lit(0.0), mark).alias("dsr"))


def wfe(folds: DataFrame, sharpe: str = "score", loss: str = "loss") -> DataFrame:
    """(config, wfe): mean Sharpe ratio out of sample over the mean of 1 / (1 + loss) in sample, to four places."""
    s = folds.groupBy("config").agg(F.avg(sharpe).alias("out"), F.avg(1 / (1 + F.greatest(F.col(loss), F.lit(0.0)))).alias("in"))
    return s.select("config", F.round(F.when(F.abs("in") >= 1e-10, F.col("out") / F.col("in")), 4).alias("wfe"))


def pbo_cscv(folds: DataFrame, most: int = 20) -> DataFrame:
    """(pbo, n_splits) from (config, fold, loss, score): over all halves of the folds, how often the best config in-sample ranks below the middle out of sample.

    The halves are the bit masks of so many ones; folds are numbered 0 .. N - 1
    with N at most `most`, so the masks are at most 2^20.
    """
    n = folds.agg(F.max("fold") + 1).first()[0]
    if n is None or n % 2 or n > most:
        raise ValueError("the number of folds must be even and small")
    masks = folds.sparkSession.range(1 << n).where(F.bit_count("id") == n // 2).select(F.col("id").alias("mask"))
    j = folds.join(masks).withColumn("inside", F.expr("(shiftright(mask, CAST(fold AS INT)) & 1) = 1"))
    per = j.groupBy("mask", "config").agg(F.avg(F.when(F.col("inside"), F.col("loss"))).alias("is_loss"), F.avg(F.when(~F.col("inside"), F.col("score"))).alias("oos"))
    w = Window.partitionBy("mask")
    r = per.withColumns({"best": F.row_number().over(w.orderBy("is_loss", "config")), "rank": F.row_number().over(w.orderBy("oos", "config")), "m": F.count("*").over(w)})
    omega = F.col("rank") / (F.col("m") + 1)
    return r.where("best = 1").agg(F.avg((F.log(omega / (1 - omega)) < 0).cast("double")).alias("pbo"), F.count("*").alias("n_splits"))


def fold_summary(folds: DataFrame) -> DataFrame:
    return folds.groupBy("config").agg(F.avg("score").alias("mean"), F.min("score").alias("worst"), F.stddev_pop("score").alias("dispersion"), F.count("*").alias("n"), ((F.avg("score") >= 6) & (F.min("score") > -2)).alias("accepted"))


def ledger_metrics(trades: DataFrame, order: list[str], spread_cost: str | None = None, capital: float = 1.0) -> DataFrame:
    """One row: trades, winners, losers, win rate, mean win and loss (as sizes), ev, profit factor, sharpe, drawdown, spread drag, return.

    sharpe is the mean PnL over its population deviation times sqrt(252), 0
    for a single trade; a PnL of 0 loses; the profit factor is infinite without
    losses; the drawdown is the worst share of the peak of capital plus summed
    PnL, a step for each value of `order`.
    """
    pnl, win = F.col("pnl"), F.col("pnl") > 0
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    m = trades.agg(
        F.count("*").alias("trades"), F.count_if(win).alias("winners"), F.count_if(~win).alias("losers"), zero(F.avg(F.when(win, pnl))).alias("avg_win"), zero(F.avg(F.when(~win, -pnl))).alias("avg_loss"),
        zero(F.sum(F.when(win, pnl))).alias("__up"), zero(F.sum(F.when(~win, -pnl))).alias("__down"), F.avg(pnl).alias("__m"), F.stddev_pop(pnl).alias("__s"), zero(F.sum(spread_cost or F.lit(0.0))).alias("spread_drag"), zero(F.sum(pnl)).alias("__all"),
    )
    rate = zero(F.try_divide(F.col("winners"), F.col("trades")))
    m = m.withColumns({
        "win_rate": rate, "ev": rate * F.col("avg_win") - (1 - rate) * F.col("avg_loss"), "profit_factor": F.when(F.col("__down") > 0, F.col("__up") / F.col("__down")).otherwise(float("inf")),
        "sharpe": F.when(F.col("trades") > 1, F.col("__m") / (F.col("__s") + 1e-10) * math.sqrt(252)).otherwise(0.0), "return_share": F.col("__all") / capital,
    })
    day = trades.groupBy(*order).agg(F.sum("pnl").alias("x"))
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    eq = day.withColumn("eq", capital + F.sum("x").over(w)).withColumn("peak", F.greatest(F.max("eq").over(w), F.lit(capital)))
    return m.drop("__up", "__down", "__m", "__s", "__all").join(eq.agg(zero(F.max((F.col("peak") - F.col("eq")) / F.col("peak"))).alias("drawdown")))


def ledger_breakdown(trades: DataFrame, bucket: str) -> DataFrame:
    """(reason, tercile, trades, pnl, win_rate): terciles of a column over all trades."""
    q = exact_quantiles(trades, [], bucket, [1 / 3, 2 / 3])
    t = F.when(F.col(bucket) <= F.col("q0"), "low").when(F.col(bucket) <= F.col("q1"), "mid").otherwise("high")
    return trades.join(F.broadcast(q)).withColumn("tercile", t).groupBy("reason", "tercile").agg(F.count("*").alias("trades"), F.sum("pnl").alias("pnl"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"))


def confidence_buckets(rows: DataFrame, edges: DataFrame, confidence: str, ret: str) -> DataFrame:
    """(lo, hi, n, win_rate, avg_ret) of each bucket [lo, hi), empty ones kept; edges is a small table."""
    j = rows.join(F.broadcast(edges), (F.col(confidence) >= F.col("lo")) & (F.col(confidence) < F.col("hi")))
    s = j.groupBy("lo", "hi").agg(F.count(ret).alias("n"), F.avg((F.col(ret) > 0).cast("double")).alias("win_rate"), F.avg(ret).alias("avg_ret"))
    return edges.join(s, ["lo", "hi"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "win_rate": F.coalesce("win_rate", F.lit(0.0)), "avg_ret": F.coalesce("avg_ret", F.lit(0.0))})


def daily_pnl(trades: DataFrame, day: str) -> DataFrame:
    """(day, pnl, cumulative): realised on the day, and since the start."""
    d = trades.groupBy(F.col(day).alias("day")).agg(F.sum("pnl").alias("pnl"))
    return d.withColumn("cumulative", F.sum("pnl").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def portfolio_stats(curve: DataFrame, weights: DataFrame, capital: float = 1.0) -> DataFrame:
    """One row on an equity curve (dt, ret, turnover, equity) and its weights (symbol, dt, w).

    total_return, sharpe and sortino (population deviations, sqrt(252); 0 when
    flat or below two losses), calmar, max_drawdown, hit_rate, bars, turnover,
    and the mean long, short, gross and net exposure of a bar.
    """
    w = Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    c = curve.withColumn("__peak", F.greatest(F.max("equity").over(w), F.lit(capital))).withColumn("dd", (F.col("__peak") - F.col("equity")) / (F.col("__peak") + 1e-10))
    lost = F.when(F.col("ret") < 0, F.col("ret"))
    s = c.agg(F.avg("ret").alias("m"), F.stddev_pop("ret").alias("s"), F.stddev_pop(lost).alias("d"), F.count(lost).alias("losses"), F.avg((F.col("ret") > 0).cast("double")).alias("hit_rate"), F.count("*").alias("bars"), F.avg("turnover").alias("turnover"), F.max("dd").alias("max_drawdown"), F.max_by("equity", "dt").alias("last"))
    held = weights.groupBy("dt").agg(F.sum(F.greatest("w", F.lit(0.0))).alias("long"), F.sum(F.greatest(-F.col("w"), F.lit(0.0))).alias("short")).agg(F.avg("long").alias("long"), F.avg("short").alias("short"))
    root = math.sqrt(252)
    ratio = lambda a, b: F.coalesce(F.when(b > 0, a / b), F.lit(0.0))
    total = F.col("last") / capital - 1
    return s.join(held).select(
        total.alias("total_return"), ratio(F.col("m") * root, F.col("s")).alias("sharpe"), F.when(F.col("losses") > 1, ratio(F.col("m") * root, F.col("d"))).otherwise(0.0).alias("sortino"), ratio(total, F.col("max_drawdown")).alias("calmar"),
        "max_drawdown", "hit_rate", "bars", "turnover", "long", "short", (F.col("long") + F.col("short")).alias("gross"), (F.col("long") - F.col("short")).alias("net"),
    )


def attribution(weights: DataFrame, capital: float = 1.0) -> DataFrame:
    """(symbol, pnl) of weights (symbol, dt, w, ret): what each symbol's weights earned."""
    return weights.groupBy("symbol").agg((F.sum(F.col("w") * F.col("ret")) * capital).alias("pnl"))


def waterfall(rows: DataFrame, reason: str) -> DataFrame:
    """(reason, n, rate)."""
    total = rows.agg(F.count("*").alias("__n"))
    return rows.groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n")).join(F.broadcast(total)).select("reason", "n", (F.col("n") / F.col("__n")).alias("rate"))


def top_by(rows: DataFrame, keys: list[str], value: Column, k: int) -> DataFrame:
    """The k keys of the greatest value."""
    return rows.groupBy(*keys).agg(value.alias("value"), F.count("*").alias("n")).orderBy(F.col("value").desc(), *keys).limit(k)


def feature_label_corr(long: DataFrame, k: int, forced: list[str]) -> DataFrame:
    """The k features of the greatest |corr| with the label, and the forced ones; long: (feature, x, y). Constant features have 0."""
    c = long.groupBy("feature").agg(F.coalesce(F.abs(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))), F.lit(0.0)).alias("corr"))
    r = c.withColumn("rank", F.row_number().over(Window.orderBy(F.col("corr").desc(), "feature")))
    return r.where((F.col("rank") <= k) | F.col("feature").isin(forced))
