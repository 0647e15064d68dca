"""Completeness and quality of bar and tick tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.quantiles import exact_quantiles


def audit_coverage(b: DataFrame, expected: DataFrame, period: Column, step_s: int, trading: float = 5 / 7) -> DataFrame:
    """(period, symbol, n, first, last, expected, pct, status) for every period seen and expected symbol."""
    have = b.groupBy(period.alias("period"), "symbol").agg(F.count("*").alias("n"), F.min("dt").alias("first"), F.max("dt").alias("last"))
    grid = b.select(period.alias("period")).distinct().join(F.broadcast(expected.select("symbol").distinct()))
    j = grid.join(have, ["period", "symbol"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    want = F.greatest(F.floor(F.timestamp_diff("SECOND", F.col("first"), F.col("last")) / step_s * trading) + 1, F.lit(1))
    j = j.withColumn("expected", F.coalesce(want, F.lit(0))).withColumn("pct", F.coalesce(F.try_divide(F.col("n") * 100.0, F.col("expected")), F.lit(0.0)))
    return j.withColumn("status", F.when(F.col("n") == 0, "missing").when(F.col("pct") >= 98, "full").when(F.col("pct") >= 80, "partial").otherwise("sparse"))


def audit_gaps(b: DataFrame, step_s: int, weekend_s: int = 56 * 3600) -> DataFrame:
    """(symbol, max_gap_s, gaps, weekend_gaps, odd_gaps): gaps exceed three steps, weekend ones touch a weekend and are not too long."""
    w = Window.partitionBy("symbol").orderBy("dt")
    g = b.select("symbol", "dt", F.lag("dt").over(w).alias("before")).withColumn("gap", F.timestamp_diff("SECOND", F.col("before"), F.col("dt")))
    long = F.col("gap") > 3 * step_s
    weekend = long & (F.weekday("before") >= 4) & (F.col("gap") <= weekend_s)
    return g.groupBy("symbol").agg(F.max("gap").alias("max_gap_s"), F.count_if(long).alias("gaps"), F.count_if(weekend).alias("weekend_gaps"), F.count_if(long & ~weekend).alias("odd_gaps"))


def audit_intraday(b: DataFrame, active: float = 0.35) -> DataFrame:
    """(symbol, expected, found, missing): expected bars a weekday are the rounded .9 quantile of its daily counts if it is active often enough."""
    day = b.groupBy("symbol", F.to_date("dt").alias("day")).agg(F.count("*").alias("n"))
    span = b.groupBy("symbol").agg(F.min(F.to_date("dt")).alias("a"), F.max(F.to_date("dt")).alias("z"))
    cal = span.select("symbol", F.explode(F.sequence("a", "z")).alias("day")).join(day, ["symbol", "day"], "left").withColumn("wd", F.weekday("day"))
    rule = cal.groupBy("symbol", "wd").agg(F.percentile("n", F.lit(0.9)).alias("q"), (F.count("n") / F.count("*")).alias("share"))
    rule = rule.select("symbol", "wd", F.when(F.col("share") >= active, F.round("q")).otherwise(0.0).alias("want"))
    j = cal.join(rule, ["symbol", "wd"])
    return j.groupBy("symbol").agg(F.sum("want").alias("expected"), F.sum(F.coalesce("n", F.lit(0))).alias("found"), F.sum(F.greatest(F.col("want") - F.coalesce("n", F.lit(0)), F.lit(0.0))).alias("missing"))


def audit_spreads(ticks: DataFrame) -> DataFrame:
    """(symbol, min, max, mean, median, zeros, negative) of the spreads; the median is exact, without a symbol's spreads in one task."""
    m = ticks.groupBy("symbol").agg(F.min("spread").alias("min"), F.max("spread").alias("max"), F.avg("spread").alias("mean"), F.count_if(F.col("spread") == 0).alias("zeros"), F.count_if(F.col("spread") < 0).alias("negative"))
    return m.join(exact_quantiles(ticks, ["symbol"], "spread", [0.5]).withColumnRenamed("q0", "median"), "symbol", "left")


def top_flags(ticks: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent flags a symbol."""
    c = ticks.groupBy("symbol", "flags").agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("n").desc(), "flags"))).where(F.col("rank") <= k)


def audit_rollup(coverage: DataFrame) -> DataFrame:
    """(symbol, period, n_missing, n): missing by symbol and by period, in one pass over grouping sets."""
    return coverage.groupingSets([["symbol"], ["period"]], "symbol", "period").agg(F.count_if(F.col("status") == "missing").alias("n_missing"), F.count("*").alias("n"))


def inspect_table(b: DataFrame) -> DataFrame:
    return b.groupBy("symbol").agg(F.count("*").alias("n"), F.min("dt").alias("first"), F.max("dt").alias("last"))


def seasonal_profile_fill(b: DataFrame, column: str, key: Column) -> DataFrame:
    """Nulls of a column filled with the median of their season (hour of week), else the overall median."""
    keyed = b.withColumn("__k", key)
    by = exact_quantiles(keyed, ["__k"], column, [0.5]).withColumnRenamed("q0", "__m")
    overall = exact_quantiles(keyed, [], column, [0.5]).withColumnRenamed("q0", "__g")
    return keyed.join(by, "__k", "left").join(F.broadcast(overall), how="left").withColumn(column, F.coalesce(column, "__m", "__g")).drop("__k", "__m", "__g")


def dataset_coverage(rows: DataFrame, values: list[str], label: str) -> DataFrame:
    """Rows, share of valid ones and of positive labels, values that are null or not finite."""
    bad = sum((F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) for c in values), F.lit(0))
    return rows.agg(F.count("*").alias("n"), F.avg(F.col("valid").cast("double")).alias("valid_ratio"), F.avg((F.col(label) > 0).cast("double")).alias("positive_ratio"), bad.alias("non_finite"))


def matrix_diagnostics(rows: DataFrame, values: list[str]) -> DataFrame:
    """(feature, n, non_finite, variance, constant) of each column, by one unpivot."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(v).alias("feature"), F.col(v).cast("double").alias("x")) for v in values))).alias("s")).select("s.*")
    return long.groupBy("feature").agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull() | F.isnan("x")).alias("non_finite"), F.var_pop("x").alias("variance"), F.coalesce(F.var_pop("x") < 1e-12, F.lit(True)).alias("constant"))
