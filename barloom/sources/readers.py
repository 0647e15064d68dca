"""Readers of tick and candle files: fixed target columns, several source dialects."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TICK_TARGET = ["symbol", "ts", "id", "bid", "ask", "flags"]
BAR_NAMES = {"bar_time": "dt", "time": "dt", "datetime": "dt", "open": "o", "high": "h", "low": "l", "close": "c", "tick_volume": "tk", "tickvol": "tk", "volume": "tk", "spread": "sp"}
STAMPS = ["yyyy.MM.dd HH:mm:ss.SSS", "yyyy.MM.dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm"]


def any_stamp(text: Column) -> Column:
    """A timestamp without zone from any of the known forms; null if none fits."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in STAMPS)).cast("timestamp_ntz")


def scan_ticks(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Tick CSV with <DATE>,<TIME>,<BID>,<ASK>,...,<FLAGS>, or time_msc,...: (symbol from the file's name, ts, id, bid, ask, flags).

    Malformed lines are dropped; missing flags are 6; empty sides are null; id
    orders rows of one time by their place in the file.
    """
    raw = spark.read.option("mode", "DROPMALFORMED").csv(path, sep=sep, header=True, encoding=encoding, recursiveFileLookup=True)
    names = {c: c.strip().strip("<>").lower() for c in raw.columns}
    raw = raw.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.input_file_name().alias("__file"), F.monotonically_increasing_id().alias("id"))
    have = set(names.values())
    if "time_msc" in have:
        ts = F.timestamp_millis(F.col("time_msc").try_cast("bigint")).cast("timestamp_ntz")
    else:
        ts = any_stamp(F.concat_ws(" ", "date", "time"))
    number = lambda c, t: F.col(c).try_cast(t) if c in have else F.lit(None).cast(t)
    out = raw.select(symbol_of(F.col("__file")).alias("symbol"), ts.alias("ts"), "id", number("bid", "double").alias("bid"), number("ask", "double").alias("ask"), F.coalesce(number("flags", "int"), F.lit(6)).alias("flags"))
    return out.where("ts is not null")


def symbol_of(file: Column) -> Column:
    """The file's stem up to the first underscore or dot, upper case; of a Spark part file that of its folder, after any `name=`."""
    part = r"/(?:[^/=]*=)?([A-Za-z0-9]+)[^/]*/part-[^/]*$"
    return F.upper(F.when(file.rlike(part), F.regexp_extract(file, part, 1)).otherwise(F.regexp_extract(file, r"([A-Za-z0-9]+)[^/]*$", 1)))


def scan_candles(spark: SparkSession, path: str | list[str], header: bool = True, sep: str = ",") -> DataFrame:
    """Candle CSV in any known dialect: (file, dt, o, h, l, c, sp, tk); unparsable rows are dropped, missing sp and tk are 0.

    Each file has its own header, so files with other names or another order of
    columns lie side by side. One pass finds the headers (a row a file), the
    other picks each line's fields by its file's names. Fields hold no quotes.
    """
    lines = spark.read.text(path, recursiveFileLookup=True).select("value", F.input_file_name().alias("file"))
    fields = F.split(F.col("value"), F.lit(re.escape(sep)))
    if header:
        head = F.lower("value").rlike("open") & F.lower("value").rlike("close")
        known = F.create_map(*(F.lit(x) for pair in BAR_NAMES.items() for x in pair))
        plain = F.transform(F.split(F.lower(F.min("value")), F.lit(re.escape(sep))), lambda x: F.regexp_replace(x, r"[<>\s\"\uFEFF]", ""))
        names = lines.where(head).groupBy("file").agg(F.transform(plain, lambda x: F.coalesce(known[x], x)).alias("names"))
        rows = lines.where(~head).join(names, "file")
    else:
        rows = lines.withColumn("names", F.array(*map(F.lit, ["dt", "o", "h", "l", "c", "tk", "sp"])))
    value = lambda n, t: F.get(F.col("fields"), F.array_position("names", n).cast("int") - 1).try_cast(t)
    rows = rows.withColumn("fields", F.transform(fields, lambda x: F.trim(x)))
    out = rows.select("file", any_stamp(value("dt", "string")).alias("dt"), *(value(n, "double").alias(n) for n in "ohlc"), F.coalesce(value("sp", "double"), F.lit(0.0)).alias("sp"), F.coalesce(value("tk", "bigint"), F.lit(0)).alias("tk"))
    return out.where("dt is not null and c is not null")


def quarters(start: str, end: str) -> list[tuple[int, int]]:
    """(year, quarter) of each quarter that [start, end] touches; dates as yyyy-MM-dd."""
    at = lambda day: int(day[:4]) * 4 + (int(day[5:7]) - 1) // 3
    return [(q // 4, q % 4 + 1) for q in range(at(start), at(end) + 1)]


def existing(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The patterns that any file fits; Hadoop's own listing, so any store will do."""
    jvm = spark.sparkContext._jvm
    out = []
    for p in patterns:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if len(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []):
            out.append(p)
    return out


def scan_partitioned_tree(spark: SparkSession, root: str, alias: DataFrame | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """{year}/{Qn}/{symbol}/candles_{tf}.csv as bars with year, quarter, symbol, tf; alias: (alias, symbol). With start and end only their quarters' folders are listed and read."""
    paths = [f"{root}/{y}/Q{q}/*/candles_*" for y, q in quarters(start, end)] if start and end else [f"{root}/*/Q*/*/candles_*"]
    b = scan_candles(spark, found) if (found := existing(spark, paths)) else spark.createDataFrame([], "file string, dt timestamp_ntz, o double, h double, l double, c double, sp double, tk bigint")
    part = lambda i: F.regexp_extract("file", r"(\d{4})/(Q\d)/([^/]+)/candles_([^./]+)", i)
    b = b.withColumns({"year": part(1).try_cast("int"), "quarter": part(2), "symbol": part(3), "tf": part(4)}).drop("file")
    if alias is not None:
        b = b.join(alias.select(F.col("alias").alias("__a"), F.col("symbol").alias("__s")), F.col("symbol") == F.col("__a"), "left").withColumn("symbol", F.coalesce("__s", "symbol")).drop("__a", "__s")
    if start:
        b = b.where(F.col("dt") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        b = b.where(F.col("dt") <= F.lit(f"{end} 23:59:59").cast("timestamp_ntz"))
    return b


#: Names under which micro bars' columns come.
MICRO_NAMES = {**BAR_NAMES, "timestamp": "dt", "bid_ask_spread": "sp", "ticks": "tk", "tick_count": "tk"}


def scan_micro_bars(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Micro bars of Parquet or CSV under their final names, one row a (symbol, dt): that of the newest file, in it the last.

    Without a symbol column the symbol is that of the file's name.
    """
    raw = spark.read.csv(path, header=True, recursiveFileLookup=True) if form == "csv" else spark.read.parquet(path)
    names = {c: MICRO_NAMES.get(c.strip().lower(), c.strip().lower()) for c in raw.columns}
    rows = raw.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.col("_metadata.file_modification_time").alias("__age"), F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__id"))
    if "symbol" not in rows.columns:
        rows = rows.withColumn("symbol", symbol_of(F.col("__file")))
    if form == "csv":
        kinds = {"dt": any_stamp(F.col("dt")), "tk": F.col("tk").try_cast("bigint")}
        rows = rows.withColumns({c: kinds.get(c, F.col(c).try_cast("double")) for c in rows.columns if c != "symbol" and not c.startswith("__")})
    w = Window.partitionBy("symbol", "dt").orderBy(F.col("__age").desc(), F.col("__file").desc(), F.col("__id").desc())
    return rows.where("dt is not null").withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__age", "__file", "__id")


JSON_BARS = "map<string, array<struct<dt:string,o:double,h:double,l:double,c:double,sp:double,tk:bigint,tp:array<double>>>>"


def scan_json_bars(spark: SparkSession, path: str) -> DataFrame:
    """{symbol: [bar, ...]} files as rows."""
    text = spark.read.text(path, wholetext=True)
    return json_bars(text, "value")


def json_bars(rows: DataFrame, column: str) -> DataFrame:
    m = rows.select(F.explode(F.from_json(column, JSON_BARS)).alias("symbol", "bars"))
    return m.select("symbol", F.explode("bars").alias("b")).select("symbol", any_stamp(F.col("b.dt")).alias("dt"), "b.o", "b.h", "b.l", "b.c", "b.sp", "b.tk", F.col("b.tp").alias("tick_path"))


def file_instrument_match(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, symbol): the longest symbol that the file's stem or folder contains; null if none. symbols is a dimension."""
    name = F.upper(F.regexp_extract("file", r"([^/]+/)?[^/]+$", 0))
    j = files.withColumn("__n", name).join(symbols.select("symbol"), F.col("__n").contains(F.upper("symbol")), "left")
    w = Window.partitionBy("file").orderBy(F.length("symbol").desc_nulls_last(), "symbol")
    return j.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select("file", "symbol")
