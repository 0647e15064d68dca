"""Exact quantiles of large columns without a group's values in one task.

A pass counts the values of each range of a histogram; the ranges that hold the
wanted ranks are cut again, between their own least and greatest value, until
each has few values or only one. Then the ranks are read off.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranges that a pass cuts a range into, and values of a range that is sorted.
CUTS, FEW = 4_096, 20_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or on local masters a temporary folder where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own(spark.sparkContext.applicationId)


@functools.lru_cache
def _own(application: str) -> str:
    return tempfile.mkdtemp(prefix="barloom-")


def kept(df: DataFrame, *by: str) -> DataFrame:
    """df, written to the shared folder and read again: what follows does not repeat what came before. by: columns with a folder a value."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/barloom-kept-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], few: int | None = None) -> DataFrame:
    """(keys..., q0, q1, ...): of each group the quantiles at `shares` of a double column, linear between neighbouring ranks.

    Equal to the percentile aggregate. Values that are null or NaN are left
    out, groups without any are not listed; infinite values are not allowed.
    """
    few = few or FEW
    names = [f"__k{i}" for i in range(len(keys))]
    v = kept(rows.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(value).cast("double").alias("__v")).where("__v is not null and not isnan(__v)"))
    groups = v.groupBy(*names).agg(F.count("*").alias("__n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    # an open range of a group: values in [lo, hi], the number of those below it, and the ranks that lie in it
    ranks = F.flatten(F.array(*(F.array(F.floor(F.lit(s) * (F.col("__n") - 1)), F.ceil(F.lit(s) * (F.col("__n") - 1))) for s in shares)))
    opened = kept(groups.select(*names, F.lit(0).cast("bigint").alias("below"), "lo", "hi", F.col("__n").alias("count"), F.array_distinct(ranks).alias("ranks")))
    found = None
    while True:
        done = opened.where(f"count <= {few} or lo = hi")
        inside = v.alias("v").join(done.where("lo < hi").alias("r"), _match("v", "r", names) & (F.col("v.__v") >= F.col("r.lo")) & (F.col("v.__v") <= F.col("r.hi")))
        sorted_ = inside.groupBy(*(F.col(f"r.{n}").alias(n) for n in names), F.col("r.below").alias("below"), F.col("r.ranks").alias("ranks")).agg(F.array_sort(F.collect_list("v.__v")).alias("x"))
        picked = sorted_.select(*names, F.explode("ranks").alias("rank"), "below", "x").select(*names, "rank", F.get("x", (F.col("rank") - F.col("below")).cast("int")).alias("x"))
        alike = done.where("lo = hi").select(*names, F.explode("ranks").alias("rank"), F.col("lo").alias("x"))
        part = kept(picked.unionAll(alike))
        found = part if found is None else found.unionAll(part)
        wide = opened.where(f"count > {few} and lo < hi")
        if wide.isEmpty():
            break
        v_, lo, hi = F.col("v.__v"), F.col("r.lo"), F.col("r.hi")
        narrow = ((lo > 0) & (hi / 2 < lo)) | ((hi < 0) & (lo / 2 > hi))  # no more than doubles: cut evenly, else by magnitude
        share = F.when(narrow, (v_ - lo) / (hi - lo)).otherwise((_size(v_) - _size(lo)) / (_size(hi) - _size(lo)))
        at = F.least(F.floor(share * CUTS), F.lit(CUTS - 1))
        cut = v.alias("v").join(wide.alias("r"), _match("v", "r", names) & (F.col("v.__v") >= F.col("r.lo")) & (F.col("v.__v") <= F.col("r.hi")))
        bins = cut.groupBy(*(F.col(f"r.{n}").alias(n) for n in names), F.col("r.below").alias("base"), F.col("r.ranks").alias("ranks"), at.alias("bin")).agg(F.count("*").alias("count"), F.min("v.__v").alias("lo"), F.max("v.__v").alias("hi"))
        w = Window.partitionBy(*names, "base").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("below", F.col("base") + F.coalesce(F.sum("count").over(w), F.lit(0)))
        bins = bins.withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("count")))).where(F.size("ranks") > 0)
        opened = kept(bins.select(*names, "below", "lo", "hi", "count", "ranks"))
    at_rank = found.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("m"))
    out = groups.alias("g").join(at_rank.alias("f"), _match("g", "f", names))
    made = []
    for i, s in enumerate(shares):
        place = F.lit(s) * (F.col("__n") - 1)
        a, b = F.element_at("m", F.floor(place)), F.element_at("m", F.ceil(place))
        made.append(F.when(a == b, a).otherwise((F.ceil(place) - place) * a + (place - F.floor(place)) * b).alias(f"q{i}"))
    return out.select(*(F.col(f"g.{n}").alias(k) for k, n in zip(keys, names, strict=True)), *made)


def _size(x: Column) -> Column:
    """Grows with x, by its sign and the logarithm of its size."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log(F.abs(x)) + 800))


def _match(a: str, b: str, names: list[str]) -> Column:
    return functools.reduce(lambda x, y: x & y, (F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names), F.lit(True))
