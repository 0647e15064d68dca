"""Cross-asset graph per bar, as edge and node tables, and market-wide aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import clip
from barloom.operators.align import pair_self_join
from barloom.operators.quantiles import exact_quantiles


def rolling_corr(rets: DataFrame, n: int = 60, least: int = 10, shrink: float = 0.85) -> DataFrame:
    """(dt, a, b, corr) over the n common bars before dt, that bar excluded; null under `least` rows, 0 on constant data."""
    pairs = pair_self_join(rets, "ret")
    w = Window.partitionBy("a", "b").orderBy("dt").rowsBetween(-n, -1)
    rho = F.try_divide(F.covar_pop("x", "y").over(w), F.greatest(F.stddev_pop("x").over(w), F.lit(1e-10)) * F.greatest(F.stddev_pop("y").over(w), F.lit(1e-10)))
    return pairs.select("dt", "a", "b", F.when(F.count("*").over(w) >= least, shrink * clip(rho, -1, 1)).alias("corr"))


def mantegna_distance(rho: Column) -> Column:
    return F.sqrt(F.greatest(2 * (1 - rho), F.lit(1e-10)))


def gaussian_adjacency(edges: DataFrame) -> DataFrame:
    """Adds dist and adj = exp(-d^2 / (2 sigma^2)), sigma being the bar's median distance (mean, or 1, if that is 0)."""
    d = edges.where("corr is not null").withColumn("dist", mantegna_distance(F.col("corr")))
    sigma = d.groupBy("dt").agg(F.percentile("dist", F.lit(0.5)).alias("med"), F.avg("dist").alias("mean"))
    sigma = sigma.select("dt", F.when(F.col("med") > 1e-10, F.col("med")).when(F.col("mean") > 1e-10, F.col("mean")).otherwise(1.0).alias("sigma"))
    return d.join(sigma, "dt").withColumn("adj", F.exp(-F.col("dist") * F.col("dist") / (2 * F.col("sigma") * F.col("sigma")))).drop("sigma")


def node_residual(edges: DataFrame, rets: DataFrame) -> DataFrame:
    """(dt, symbol, degree, residual): return less the neighbours' weighted mean; alone the residual is 0."""
    both = edges.select("dt", F.col("a").alias("symbol"), F.col("b").alias("other"), "adj").unionByName(edges.select("dt", F.col("b").alias("symbol"), F.col("a").alias("other"), "adj"))
    near = both.join(rets.select("dt", F.col("symbol").alias("other"), F.col("ret").alias("r")), ["dt", "other"])
    sums = near.groupBy("dt", "symbol").agg(F.sum("adj").alias("degree"), F.sum(F.col("adj") * F.col("r")).alias("pull"))
    out = sums.join(rets.select("dt", "symbol", "ret"), ["dt", "symbol"])
    return out.select("dt", "symbol", "degree", F.coalesce(F.col("ret") - F.try_divide(F.col("pull"), F.col("degree")), F.lit(0.0)).alias("residual"))


def spectrum_of(adjacency: np.ndarray) -> tuple[float, int, int, float, float]:
    """(gap, beta0, beta1, h1, trace) of the normalised Laplacian of one bar's weights.

    beta0 counts eigenvalues below .01, at least 1; beta1 those from .3 to .7
    of the largest, both ends included; h1 is their spread, 0 if fewer than two.
    """
    root = 1 / np.sqrt(np.maximum(adjacency.sum(axis=1), 1e-10))
    laplacian = np.eye(len(adjacency)) - root[:, None] * adjacency * root[None, :]
    e = np.maximum(np.linalg.eigvalsh(laplacian), 0.0)
    top = e[-1] if e[-1] > 1e-10 else 1.0
    mid = e[(e >= 0.3 * top) & (e <= 0.7 * top)]
    return float(e[1]) if len(e) > 1 else 0.0, max(1, int((e < 0.01).sum())), len(mid), float(mid[-1] - mid[0]) if len(mid) > 1 else 0.0, float(np.trace(laplacian))


def laplacian_spectrum(edges: DataFrame, every: int = 5) -> DataFrame:
    """(dt, gap, beta0, beta1, h1, trace) at the first bar with edges and each `every` bars after it; one group a bar, n x n in memory."""
    order = edges.select("dt").distinct().withColumn("__i", F.row_number().over(Window.orderBy("dt")) - 1)
    chosen = edges.join(order.where(f"__i % {every} = 0"), "dt")

    def spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {s: i for i, s in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        i, j = pdf["a"].map(at).to_numpy(), pdf["b"].map(at).to_numpy()
        m[i, j] = m[j, i] = pdf["adj"].to_numpy()
        return pd.DataFrame([(pdf["dt"].iloc[0], *spectrum_of(m))], columns=["dt", "gap", "beta0", "beta1", "h1", "trace"])

    return chosen.groupBy("dt").applyInPandas(spectrum, "dt timestamp_ntz, gap double, beta0 int, beta1 int, h1 double, trace double")


def held_spectrum(timeline: DataFrame, spectrum: DataFrame) -> DataFrame:
    """The spectrum at each time, held from its last computation; one row a bar."""
    w = Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return timeline.join(spectrum, "dt", "left").select("dt", *(F.last(c, ignorenulls=True).over(w).alias(c) for c in ("gap", "beta0", "beta1", "h1", "trace")))


def smoothed_h1(held: DataFrame, alpha: float = 0.3, frame: int = 200) -> DataFrame:
    """h1_ema: EMA of h1 from 0 over the bars so far; beyond `frame` bars a value weighs less than a double shows. One row a bar."""
    w = Window.orderBy("dt").rowsBetween(1 - frame, 0)
    return held.withColumn("h1_ema", F.aggregate(F.collect_list("h1").over(w), F.lit(0.0), lambda s, x: alpha * x + (1 - alpha) * s))


def regime_class(beta0: Column, beta1: Column, h1: Column, n: int) -> Column:
    """FRAGMENTED, HIGH_STRESS, TRANSITIONAL, LOW_VOL or NORMAL, the severest first; h1 is smoothed_h1's, the counts' limits scale with n symbols over 35."""
    return (
        F.when(beta0 > round(20 * n / 35), "FRAGMENTED").when(h1 > 0.8, "HIGH_STRESS").when(beta1 > round(4 * n / 35), "TRANSITIONAL")
        .when((beta1 <= 1) & (h1 < 0.2), "LOW_VOL").otherwise("NORMAL")
    )


def graph_features(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per bar: mean, deviation and largest size of residuals, mean absolute correlation."""
    by_node = nodes.groupBy("dt").agg(F.avg("residual").alias("res_mean"), F.stddev_pop("residual").alias("res_std"), F.max(F.abs("residual")).alias("res_max"))
    by_edge = edges.groupBy("dt").agg(F.avg(F.abs("corr")).alias("corr_abs"), F.count("*").alias("n_edges"))
    return by_node.join(by_edge, "dt")


def static_graph(rets: DataFrame, least: int = 16) -> DataFrame:
    """(a, b, n, corr) over all of the given span, for pairs with enough common bars."""
    pairs = pair_self_join(rets, "ret").groupBy("a", "b").agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("corr"))
    return pairs.where(F.col("n") >= least)


def typed_edges(corr: DataFrame, members: DataFrame, opened: DataFrame) -> DataFrame:
    """(dt, kind, src, dst, weight) of each bar: three relations both ways, weights of a (dt, kind, src) summing to 1.

    corr: (dt, a, b, corr) of each bar's pairs, null counting as 0; members:
    (symbol, class), a small table; opened: (dt, symbol, open). rolling_corr
    weighs by the Gaussian kernel of the distance, its scale the bar's median
    distance; fundamental is 1 within a class and .8 between six-letter symbols
    that share a currency; session joins symbols whose markets are open at the
    bar. All three are read off one row a pair and bar. A relation without
    weight has no rows.
    """
    rho = F.coalesce("corr", F.lit(0.0))
    pairs = corr.select("dt", "a", "b", F.sqrt(F.greatest(2 * (1 - rho), F.lit(1e-8))).alias("dist"))
    sigma = pairs.groupBy("dt").agg(F.greatest(F.percentile("dist", F.lit(0.5)), F.lit(1e-4)).alias("sigma"))  # a bar's pairs
    side = lambda t, s, *c: t.select(*("dt" for _ in [0] if "dt" in t.columns), F.col("symbol").alias(s), *(F.col(x).alias(f"{x}_{s}") for x in c))
    j = pairs.join(sigma, "dt")
    for s in ("a", "b"):
        j = j.join(side(members, s, "class"), s, "left").join(side(opened, s, "open"), ["dt", s], "left")
    legs = lambda s: F.array(F.substring(s, 1, 3), F.substring(s, 4, 3))
    money = (F.length("a") >= 6) & (F.length("b") >= 6) & F.arrays_overlap(legs("a"), legs("b"))
    weights = F.array(
        F.struct(F.lit("rolling_corr").alias("kind"), F.exp(-F.col("dist") * F.col("dist") / (2 * F.col("sigma") * F.col("sigma"))).alias("w")),
        F.struct(F.lit("fundamental").alias("kind"), F.when(F.col("class_a") == F.col("class_b"), 1.0).when(money, 0.8).otherwise(0.0).alias("w")),
        F.struct(F.lit("session").alias("kind"), F.when(F.col("open_a") & F.col("open_b"), 1.0).otherwise(0.0).alias("w")),
    )
    one = j.select("dt", "a", "b", F.explode(weights).alias("x")).where("x.w > 0")
    both = one.select("dt", F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"), "x.kind", "x.w")
    total = F.sum("w").over(Window.partitionBy("dt", "kind", "e.src"))
    return both.select("dt", "kind", "e.src", "e.dst", (F.col("w") / F.when(total < 1e-8, 1.0).otherwise(total)).alias("weight"))


def laggard_features(rets: DataFrame, n: int = 60, overlap: int = 6, shrink: float = 0.85) -> DataFrame:
    """(dt, symbol, nb_momentum, momentum_residual, nb_volatility, vol_laggard, laggard_score, strength) of each return's bar.

    rets: (symbol, dt, ret), a row a true return. Correlations are of the last n
    common returns, the bar's own included, 0 below `overlap` of them. A symbol's
    volatility ratio is its root mean square of 6 returns over that of 12, its
    momentum 3 returns over sqrt(3) of the latter; neighbours' are their means
    by absolute (ratio) and by signed correlation (momentum) over the degree.
    """
    w = lambda k: Window.partitionBy("symbol").orderBy("dt").rowsBetween(1 - k, 0)
    rms = lambda k: F.when(F.count("*").over(w(k)) > 1, F.sqrt(F.avg(F.col("ret") * F.col("ret")).over(w(k)))).otherwise(0.0)
    own = rets.withColumns({"__6": rms(6), "__12": rms(12), "__3": F.sum("ret").over(w(3))})
    own = own.select("dt", "symbol", (F.col("__6") / F.greatest("__12", F.lit(1e-6))).alias("ratio"), (F.col("__3") / F.greatest(F.col("__12") * 3**0.5, F.lit(1e-6))).alias("momentum"))
    p = Window.partitionBy("a", "b").orderBy("dt").rowsBetween(1 - n, 0)
    flat = (F.stddev_pop("x").over(p) < 1e-6) | (F.stddev_pop("y").over(p) < 1e-6) | (F.count("*").over(p) < overlap)
    rho = F.when(flat, 0.0).otherwise(F.try_divide(F.covar_pop("x", "y").over(p), F.stddev_pop("x").over(p) * F.stddev_pop("y").over(p)))
    edges = pair_self_join(rets, "ret").select("dt", "a", "b", (shrink * rho).alias("corr"))
    both = edges.select("dt", F.col("a").alias("symbol"), F.col("b").alias("other"), "corr").unionByName(edges.select("dt", F.col("b").alias("symbol"), F.col("a").alias("other"), "corr"))
    near = both.join(own.select("dt", F.col("symbol").alias("other"), F.col("ratio").alias("r"), F.col("momentum").alias("m")), ["dt", "other"])
    s = near.groupBy("dt", "symbol").agg(F.sum(F.abs("corr")).alias("degree"), F.sum(F.abs("corr") * F.col("r")).alias("vol"), F.sum(F.col("corr") * F.col("m")).alias("mom"), F.count("*").alias("others"))
    floor = F.greatest("degree", F.lit(1e-6))
    out = own.join(s, ["dt", "symbol"]).withColumns({"nb_momentum": F.col("mom") / floor, "nb_volatility": F.col("vol") / floor, "strength": F.col("degree") / F.col("others")})
    out = out.withColumns({"momentum_residual": F.col("momentum") - F.col("nb_momentum"), "vol_laggard": F.col("nb_volatility") - F.col("ratio")})
    score = F.greatest("vol_laggard", F.lit(0.0)) * F.least(F.abs("nb_momentum"), F.lit(3.0))
    return out.select("dt", "symbol", "nb_momentum", "momentum_residual", "nb_volatility", "vol_laggard", score.alias("laggard_score"), "strength")


def bucket_stats(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(dt, bucket, trend, dispersion, stress) over the real rows of each bucket's members; members: (symbol, bucket)."""
    j = rows.where("real").join(F.broadcast(members), "symbol")
    return j.groupBy("dt", "bucket").agg(F.avg("ret").alias("trend"), F.stddev_pop("ret").alias("dispersion"), F.avg("stress").alias("stress"))


def global_regime_stress(rets: DataFrame) -> DataFrame:
    """(dt, stress, regime): the bar's median absolute return, coded 2, 3 or 4 from the quantiles .5, .75 and .9 over all bars on, else 1.

    A return is null where the bar or the one before is not valid; a bar
    without any has no stress and regime 1.
    """
    per = rets.groupBy("dt").agg(F.percentile(F.abs("ret"), F.lit(0.5)).alias("stress"))  # a bar's symbols
    q = exact_quantiles(per, [], "stress", [0.5, 0.75, 0.9])
    s = F.col("stress")
    return per.join(F.broadcast(q), how="left").select("dt", "stress", F.when(s >= F.col("q2"), 4).when(s >= F.col("q1"), 3).when(s >= F.col("q0"), 2).otherwise(1).alias("regime"))


def basket_index(rets: DataFrame, weights: DataFrame) -> DataFrame:
    """(dt, basket): signed-weight mean return of the listed symbols present; weights: (symbol, w)."""
    j = rets.join(F.broadcast(weights), "symbol")
    return j.groupBy("dt").agg(F.try_divide(F.sum(F.col("w") * F.col("ret")), F.sum(F.abs("w"))).alias("basket"))


def net_score(nodes: DataFrame, dead: float = 1e-4) -> DataFrame:
    """(dt, net): share of residuals above the dead zone less those below."""
    return nodes.groupBy("dt").agg(((F.count_if(F.col("residual") > dead) - F.count_if(F.col("residual") < -dead)) / F.count("*")).alias("net"))


def agreement_ratio(nodes: DataFrame, floor: float, dead: float = 1e-4) -> DataFrame:
    """(dt, agreement): of a bar's symbols at or above the confidence floor, the share whose residual lies beyond the dead zone on the net score's side.

    nodes: (dt, symbol, residual, confidence). The net score counts all
    symbols; 0 where it is 0, or no symbol reaches the floor.
    """
    r, high = F.col("residual"), F.col("confidence") >= floor
    up, down = (F.count_if(x).alias(n) for x, n in ((r > dead, "up"), (r < -dead, "down")))
    s = nodes.groupBy("dt").agg(up, down, F.count_if(high).alias("n"), F.count_if(high & (r > dead)).alias("with_up"), F.count_if(high & (r < -dead)).alias("with_down"))
    aligned = F.when(F.col("up") > F.col("down"), F.col("with_up")).when(F.col("up") < F.col("down"), F.col("with_down")).otherwise(0)
    return s.select("dt", F.coalesce(F.try_divide(aligned, F.col("n")), F.lit(0.0)).alias("agreement"))


def region_influence(rets: DataFrame, influence: DataFrame) -> DataFrame:
    """(dt, target, pull): mean return of the sources that influence a target; influence: (source, target)."""
    return rets.withColumnRenamed("symbol", "source").join(F.broadcast(influence), "source").groupBy("dt", "target").agg(F.avg("ret").alias("pull"))
