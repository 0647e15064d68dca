"""Structured Streaming twins. Replayed files must arrive in time order, as rows past the watermark are dropped.

Operators with a state of their own use transformWithState, which wants the
RocksDB store (with_rocksdb). A symbol's rows of one micro-batch are put in
order in memory, so the source's files or rows per trigger bound them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from barloom import streaming
from barloom.operators.indicators import PAIR_FEATURES
from barloom.streaming.rolling import LOOKBACK, pair_features

# The worker that sets a state store up does not see files sent with addPyFile: processors travel by value.
cloudpickle.register_pickle_by_value(streaming)

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's setting is put back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class BySymbol(StatefulProcessor):
    """A symbol's rows in the order of `order`, with a list state of the fields `state`; step() gives the rows to emit and the new state."""

    state: str
    order: list[str]

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", self.state, self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = list(self.kept.get()) if self.kept.exists() else []
        out, now = self.step(pd.concat(list(rows)).sort_values(self.order, kind="stable").reset_index(drop=True), held)
        if now:
            self.kept.put(now)
        yield out

    def close(self) -> None:
        pass


def by_symbol(rows: DataFrame, processor: BySymbol, schema: str) -> DataFrame:
    """A state that expires needs processing time; others need no time."""
    return rows.groupBy("symbol").transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if processor.ttl_ms else "None")


def replay(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Bars in append mode: emitted once the watermark passes their end, equal to the batch bars."""
    at = F.struct("ts", "id")
    w = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w"))
    return w.agg(F.min_by("mid", at).alias("o"), F.max("mid").alias("h"), F.min("mid").alias("l"), F.max_by("mid", at).alias("c"), F.count("*").alias("tk")).select("symbol", F.col("w.start").alias("dt"), "o", "h", "l", "c", "tk")


def stream_dedupe(ticks: DataFrame, late: str = "1 hour") -> DataFrame:
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "ts"])


class _Ffill(BySymbol):
    state, order = "bid double, ask double", ["ts", "id"]

    def step(self, pdf: pd.DataFrame, held: list[tuple]) -> tuple[pd.DataFrame, list[tuple]]:
        for c, last in zip(("bid", "ask"), held[0] if held else (None, None), strict=True):
            filled = pdf[c].ffill()
            pdf[c] = filled if last is None else filled.fillna(last)
        ends = tuple(None if pd.isna(pdf[c].iloc[-1]) else float(pdf[c].iloc[-1]) for c in ("bid", "ask"))
        return pdf[["symbol", "ts", "id", "bid", "ask"]], [ends]


def stream_tick_ffill(ticks: DataFrame) -> DataFrame:
    """(symbol, ts, id, bid, ask) with the last known sides; state: one pair a symbol."""
    return by_symbol(ticks.select("symbol", "ts", "id", "bid", "ask"), _Ffill(), "symbol string, ts timestamp, id bigint, bid double, ask double")


class _Hysteresis(BySymbol):
    state, order = "position int", ["dt"]

    def __init__(self, entry: float, leave: float, edge: float) -> None:
        super().__init__()
        self.entry, self.leave, self.edge = entry, leave, edge

    def step(self, pdf: pd.DataFrame, held: list[tuple]) -> tuple[pd.DataFrame, list[tuple]]:
        """Each row maps the position before it (-1, 0, 1, held as 0, 1, 2) to one; the maps are put together by doubling."""
        b, s = (pdf[c].to_numpy(dtype=float, na_value=np.nan) for c in ("p_buy", "p_sell"))
        opened = np.where((b >= self.entry) & (b - s >= self.edge), 2, np.where((s >= self.entry) & (s - b >= self.edge), 0, 1))
        maps = np.stack([np.where(s < self.leave, 1, 0), opened, np.where(b < self.leave, 1, 2)], axis=1)
        span = 1
        while span < len(maps):
            maps[span:] = np.take_along_axis(maps[span:], maps[:-span], axis=1)
            span *= 2
        now = maps[:, (held[0][0] if held else 0) + 1] - 1
        return pdf[["symbol", "dt"]].assign(position=now.astype("int32")), [(int(now[-1]),)]


def stream_hysteresis(scored: DataFrame, entry: float = 0.6, leave: float = 0.52, edge: float = 0.0) -> DataFrame:
    """(symbol, dt, position) of the same machine as signals.hysteresis; state: one position a symbol."""
    return by_symbol(scored.select("symbol", "dt", "p_buy", "p_sell"), _Hysteresis(entry, leave, edge), "symbol string, dt timestamp, position int")


def on_timeline(bars: DataFrame, symbols: list[str], late: str = "1 hour") -> DataFrame:
    """(symbol, dt, o, h, l, c, sp, tk) of every symbol at every dt that any symbol has, nulls where it has no bar.

    A dt goes out once the watermark passes it. Of several bars of one symbol
    and dt any one is taken.
    """
    fields = ["o", "h", "l", "c", "sp", "tk"]
    at = bars.withWatermark("dt", late).groupBy("dt").agg(F.collect_list(F.struct("symbol", *fields)).alias("__bars"))
    each = at.withColumn("symbol", F.explode(F.array(*map(F.lit, symbols))))
    own = each.withColumn("__bar", F.get(F.filter("__bars", lambda x: x["symbol"] == F.col("symbol")), F.lit(0)))
    return own.select("symbol", "dt", *(F.col(f"__bar.{f}").alias(f) for f in fields))


class _Indicators(BySymbol):
    state, order = "o double, h double, l double, c double, sp double, tk double", ["dt"]

    def __init__(self, keep: int, warm_up: int, ttl_ms: int | None) -> None:
        super().__init__(ttl_ms)
        self.keep, self.warm_up = keep, warm_up

    def step(self, pdf: pd.DataFrame, held: list[tuple]) -> tuple[pd.DataFrame, list[tuple]]:
        names = ["o", "h", "l", "c", "sp", "tk"]
        before = pd.DataFrame(held, columns=names, dtype=float)
        new = pdf[names].astype(float)
        last = pd.concat([before["c"], new["c"]]).ffill().to_numpy()[len(before) :]
        known = ~np.isnan(last)  # before the first bar there is nothing to fill with
        pdf, new, last = pdf[known], new[known].copy(), last[known]
        absent = new["c"].isna()
        for c in names:
            new[c] = new[c].mask(absent, 0.0 if c in ("sp", "tk") else pd.Series(last, index=new.index))
        both = pd.concat([before, new], ignore_index=True)
        made = pair_features(both, len(before), pdf["pip"].to_numpy(dtype=float))
        out = pd.concat([pdf[["symbol", "dt"]].reset_index(drop=True), made], axis=1)
        warm = np.arange(len(before), len(both)) + 1 >= self.warm_up
        return out[warm], [tuple(map(float, r)) for r in both.tail(self.keep).to_numpy()]


def stream_indicators(bars: DataFrame, pip: Column, keep: int = 370, warm_up: int = 200, ttl_ms: int | None = None) -> DataFrame:
    """(symbol, dt, *PAIR_FEATURES) of indicators.pair_features_16, from a symbol's warm_up-th bar on; state: its last `keep` bars.

    A row with a null close is a symbol's missing bar (on_timeline): it gets
    the last close as its prices, no ticks and no spread; before a symbol's
    first bar such rows are dropped. With ttl_ms, a symbol that has sent
    nothing for so long is forgotten and warms up anew; such a query looks for
    expired states in batches without data, so one with availableNow ends only
    if spark.sql.streaming.noDataMicroBatches.enabled is false.
    """
    if keep < max(LOOKBACK, warm_up):
        raise ValueError(f"keep at least {LOOKBACK} bars and as many as the warm-up takes")
    given = bars.select("symbol", "dt", "o", "h", "l", "c", "sp", F.col("tk").cast("double").alias("tk"), pip.cast("double").alias("pip"))
    return by_symbol(given, _Indicators(keep, warm_up, ttl_ms), "symbol string, dt timestamp, " + ", ".join(f"{c} double" for c in PAIR_FEATURES))


class _Session(BySymbol):
    state, order = "code int, n int, hi double, lo double", ["dt"]

    def __init__(self, k: int) -> None:
        super().__init__()
        self.k = k

    def step(self, pdf: pd.DataFrame, held: list[tuple]) -> tuple[pd.DataFrame, list[tuple]]:
        """The run that the state holds is a row before the first; rows past the k-th of a run do not widen its range."""
        code, n, hi, lo = held[0] if held else (None, 0, np.nan, np.nan)
        run = pdf["session"].ne(pdf["session"].shift(fill_value=code)).cumsum()  # 0: the run of the state
        no = run.groupby(run).cumcount() + 1 + n * (run == 0)
        within = no <= self.k
        high, low = pdf["h"].where(within).groupby(run).cummax().groupby(run).ffill(), pdf["l"].where(within).groupby(run).cummin().groupby(run).ffill()
        carried = run == 0
        high, low = high.mask(carried, np.fmax(high, hi)), low.mask(carried, np.fmin(low, lo))
        out = pdf[["symbol", "dt", "session"]].assign(bars_in_run=no.astype("int32"), or_high=high, or_low=low)
        end = out.iloc[-1]
        return out, [(int(end["session"]), int(end["bars_in_run"]), float(end["or_high"]), float(end["or_low"]))]


def stream_session(bars: DataFrame, k: int = 3) -> DataFrame:
    """(symbol, dt, session, bars_in_run, or_high, or_low): runs of one session code and their opening range so far; k is at least 1."""
    return by_symbol(bars.select("symbol", "dt", "session", "h", "l"), _Session(k), "symbol string, dt timestamp, session int, bars_in_run int, or_high double, or_low double")


def late_rows(query: StreamingQuery) -> DataFrame:
    """(batch, operator, dropped): rows that came behind the watermark, by micro-batch and stateful operator of a query, from its progress.

    Rows are counted as they reach the operator: before an aggregation the
    rows of a group and partition are one. A batch drops what lies behind the
    watermark of the batch before it.

    The query keeps as many of its last progress reports as
    spark.sql.streaming.numRecentProgressUpdates says.
    """
    spark = query.sparkSession if hasattr(query, "sparkSession") else SparkSession.active()
    rows = [(p["batchId"], s["operatorName"], s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"]]
    return spark.createDataFrame(rows, "batch bigint, operator string, dropped bigint").groupBy("batch", "operator").agg(F.sum("dropped").alias("dropped"))
