"""Writers: partitioned Parquet, JSON per symbol, upserts by quarter, feature tables with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sink_parquet(b: DataFrame, path: str, keys: tuple[str, ...] = ("symbol",)) -> None:
    b.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def bars_as_json(b: DataFrame, places: int = 6) -> DataFrame:
    """(symbol, bars): a JSON array of a symbol's rounded bars in time order."""
    num = lambda c: F.round(c, places).alias(c)
    item = F.struct(F.date_format("dt", "yyyy-MM-dd HH:mm").alias("dt"), num("o"), num("h"), num("l"), num("c"), num("sp"), "tk")
    return b.groupBy("symbol").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("bars"))


def sink_json(b: DataFrame, path: str) -> None:
    bars_as_json(b).repartition("symbol").write.mode("overwrite").partitionBy("symbol").text(path)


def merged_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new rows, the new one where both have a key."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col("__new").desc())
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__new", "__rn")


def sink_quarterly_upsert(spark: SparkSession, new: DataFrame, path: str) -> None:
    """Merge bars into a table partitioned by year and quarter; only the quarters that new touches are rewritten."""
    new = new.withColumns({"year": F.year("dt"), "quarter": F.quarter("dt")})
    try:
        old = spark.read.parquet(path).join(F.broadcast(new.select("year", "quarter").distinct()), ["year", "quarter"], "left_semi").select(*new.columns)
        rows = merged_rows(old, new, ["symbol", "dt"])
        staged = f"{path.rstrip('/')}__staged"
        rows.write.mode("overwrite").parquet(staged)  # a table can't be overwritten while it is read
        rows = spark.read.parquet(staged)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = new
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "quarter").parquet(path)


def sink_feature_tables(features: DataFrame, path: str) -> DataFrame:
    """Write features by tf, and return the manifest (tf, rows, first, last); a repeated run rewrites its partitions only."""
    features.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tf").parquet(f"{path}/features")
    manifest = features.groupBy("tf").agg(F.count("*").alias("rows"), F.min("dt").alias("first"), F.max("dt").alias("last"))
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return features.sparkSession.read.parquet(f"{path}/manifest")


PACK = ["o", "h", "l", "c", "sp", "tk", "validity", "session_code", "session_transition", "regime_signal"]


def export_feature_pack(features: DataFrame, path: str) -> DataFrame:
    """Write (symbol, dt, tf) with the ten channels of PACK by tf, a repeated run rewriting its partitions only, and read it back.

    features needs o, h, l, c, sp, tk, real, session (0 to 4), moved and trend.
    Session codes are scaled to 1, the trend is 0 on bars that are not real.
    """
    rows = features.select(
        "symbol", "dt", "tf", "o", "h", "l", "c", "sp", F.col("tk").cast("double").alias("tk"), F.col("real").cast("double").alias("validity"), (F.col("session") / 4).alias("session_code"),
        F.col("moved").cast("double").alias("session_transition"), F.when(F.col("real"), F.col("trend")).otherwise(0.0).alias("regime_signal"),
    )
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tf").parquet(path)
    return features.sparkSession.read.parquet(path)
