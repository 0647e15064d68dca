"""Stateful streams: equal to their batch twins row by row, over restarts, with missing symbols, and with states that expire."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators import signals
from barloom.plans import stream_queries
from barloom.streaming import rolling, streams

BAR = "symbol string, dt timestamp, o double, h double, l double, c double, sp double, tk bigint"


def series(n, seed=5):
    rng, rows, c = random.Random(seed), [], {"A": 100.0, "B": 1.2}
    for i in range(n):
        for s in c:
            c[s] *= math.exp(rng.gauss(0, 0.01)) if i % 7 or s == "A" else 1.0
            o = c[s] * (1 + rng.gauss(0, 0.002))
            rows.append((s, datetime(2024, 1, 1) + timedelta(hours=i), o, max(o, c[s]) * 1.004, min(o, c[s]) * 0.996, c[s], 0.1 * rng.random(), rng.randint(1, 9)))
    return rows


def run(spark, source, made, base):
    """One start of a stream from the folder's checkpoint until the source is read."""
    out = made(spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"))
    with streams.with_rocksdb(spark):
        q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def of(rows, columns):
    return {(r["symbol"], r["dt"]): [None if r[c] is None else float(f"{r[c]:.8g}") for c in columns] for r in rows.collect()}


def test_indicators_equal_batch_over_restarts(spark, tmp_path):
    rows = series(300)
    bars = spark.createDataFrame(rows, BAR)
    base = str(tmp_path)
    for a, b in ((0, 90), (90, 91), (91, 300)):  # each part: another start of the query
        bars.where(F.col("dt").between(rows[2 * a][1], rows[2 * b - 1][1])).coalesce(1).write.mode("append").parquet(f"{base}/in")
        live = run(spark, bars, lambda s: streams.stream_indicators(s, F.lit(0.01), keep=150, warm_up=40), base)
    got = of(live, ind.PAIR_FEATURES)
    want = of(ind.pair_features_16(bars, F.lit(0.01)), ind.PAIR_FEATURES)
    assert len(got) == 2 * 261
    for key, values in got.items():
        assert values == pytest.approx(want[key], rel=1e-6, abs=1e-7), key


def test_features_in_parts_equal_features_at_once():
    """Rows of many chunks, and short series, where most features are not defined yet."""
    rows = [r[2:] for r in series(6000) if r[0] == "A"]
    b = pd.DataFrame(rows, columns=["o", "h", "l", "c", "sp", "tk"]).astype(float)
    whole = rolling.pair_features(b, 0, np.full(len(b), 0.01))
    tail = rolling.pair_features(b.iloc[-400:].reset_index(drop=True), 370, np.full(30, 0.01))
    assert np.allclose(whole.iloc[-30:], tail, rtol=1e-9) and whole.iloc[0].isna().all() and whole.iloc[34:].notna().all().all()
    assert rolling.pair_features(b.iloc[:0], 0, np.empty(0)).empty


def test_missing_bars_take_the_last_close(spark, tmp_path):
    rows = [r for r in series(60) if not (r[0] == "B" and (r[1].hour % 5 == 2 or r[1] < datetime(2024, 1, 1, 4)))]
    bars, base = spark.createDataFrame(rows, BAR), str(tmp_path)
    bars.coalesce(1).write.parquet(f"{base}/in")
    live = run(spark, bars, lambda s: streams.stream_indicators(streams.on_timeline(s, ["A", "B"]), F.lit(0.01), keep=130, warm_up=36), base)
    held, panel = {}, []
    by = {(r[0], r[1]): r for r in rows}
    for i in range(59):  # the last hour is not past the watermark
        for s in "AB":
            at = datetime(2024, 1, 1) + timedelta(hours=i)
            r = by.get((s, at)) or (held.get(s) and (s, at, *[held[s]] * 4, 0.0, 0))
            if r:
                held[s] = r[5]
                panel.append(r)
    want = of(ind.pair_features_16(spark.createDataFrame(panel, BAR), F.lit(0.01)), ind.PAIR_FEATURES)
    got = of(live, ind.PAIR_FEATURES)
    assert len(got) == (59 - 35) + (59 - 4 - 35)
    for key, values in got.items():
        assert values == pytest.approx(want[key], rel=1e-6, abs=1e-7), key


def test_expired_symbols_warm_up_anew(spark, tmp_path):
    rows, base, key = series(80), str(tmp_path), "spark.sql.streaming.noDataMicroBatches.enabled"
    bars = spark.createDataFrame(rows, BAR)
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        for a, b in ((0, 50), (50, 80)):
            bars.where(F.col("dt").between(rows[2 * a][1], rows[2 * b - 1][1])).coalesce(1).write.mode("append").parquet(f"{base}/in")
            live = run(spark, bars, lambda s: streams.stream_indicators(s, F.lit(0.01), keep=130, warm_up=25, ttl_ms=1), base)
    finally:
        spark.conf.set(key, before)
    assert live.count() == 2 * (50 - 24) + 2 * (30 - 24)


def test_positions_and_sessions_over_restarts(spark, tmp_path):
    rng, start = random.Random(3), datetime(2024, 1, 1)
    rows = [(s, start + timedelta(minutes=i), rng.random(), rng.random(), i // 13 % 4, 5 + rng.random(), rng.random()) for i in range(200) for s in "AB"]
    data = spark.createDataFrame(rows, "symbol string, dt timestamp, p_buy double, p_sell double, session int, h double, l double")
    pos, ses = str(tmp_path / "pos"), str(tmp_path / "ses")
    for a, b in ((0, 70), (70, 200)):
        part = data.where(F.col("dt").between(start + timedelta(minutes=a), start + timedelta(minutes=b - 1))).coalesce(1)
        for base in (pos, ses):
            part.write.mode("append").parquet(f"{base}/in")
        positions = run(spark, data, lambda s: streams.stream_hysteresis(s, edge=0.05), pos)
        sessions = run(spark, data, lambda s: streams.stream_session(s, k=3), ses)
    assert of(positions, ["position"]) == of(signals.hysteresis(data, "p_buy", "p_sell", edge=0.05), ["position"])
    want, state = {}, {}
    for s, dt, _, _, code, h, low in rows:
        c, n, hi, lo = state.get(s, (None, 0, h, low))
        n, hi, lo = (n + 1, hi, lo) if c == code else (1, h, low)
        if n <= 3:
            hi, lo = max(hi, h), min(lo, low)
        state[s] = (code, n, hi, lo)
        want[s, dt] = [float(f"{x:.8g}") for x in (code, n, hi, lo)]
    assert of(sessions, ["session", "bars_in_run", "or_high", "or_low"]) == want


def test_buffer_must_hold_the_lookback(spark):
    with pytest.raises(ValueError, match="keep at least"):
        streams.stream_indicators(spark.createDataFrame([], BAR), F.lit(1.0), keep=100)


def test_late_rows_are_counted_over_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    """Each part is several files and still one micro-batch: a late symbol and hour counts once, whichever files it lies in."""
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 60)
    monkeypatch.setattr(stream_queries, "shared_folder", lambda _: str(tmp_path))
    start = datetime(2024, 1, 1)
    q = spark.createDataFrame([("AB"[i % 2], start + timedelta(minutes=5 * i), i, float(i)) for i in range(240)], "symbol string, ts timestamp, id bigint, mid double").coalesce(1)
    dropped = stream_queries.late_of(spark, [q, q.where("id = 239"), q.where("id < 200 and id % 3 = 0")], streams.stream_bars)
    assert len(list(tmp_path.glob("late-*/in/part-*"))) == 4 + 1 + 2
    assert dropped.agg(F.sum("dropped")).first()[0] == len({("AB"[i % 2], i // 12) for i in range(0, 200, 3)})


def test_micro_batches_are_slices_of_time(spark, monkeypatch):
    """Rows in any order reach the state in the order of time, a bounded number at once."""

    class Few(streams._Ffill):
        def step(self, pdf, held):
            if len(pdf) > 70:
                raise ValueError(f"{len(pdf)} rows of a symbol in memory")
            return super().step(pdf, held)

    monkeypatch.setattr(stream_queries, "SLICE_ROWS", 50)
    rng, start, rows = random.Random(4), datetime(2024, 1, 1), []
    for i in range(300):
        rows.append(("AB"[rng.random() < 0.3], start + timedelta(seconds=i // 2), i, *(rng.random() if rng.random() < 0.4 else None for _ in range(2))))
    want, last = {}, {}
    for s, _, i, *sides in rows:
        last[s] = want[i] = tuple(x if x is not None else y for x, y in zip(sides, last.get(s, (None, None)), strict=True))
    rng.shuffle(rows)
    data = spark.createDataFrame(rows, "symbol string, ts timestamp, id bigint, bid double, ask double").repartition(3)
    made = lambda s: streams.by_symbol(s, Few(), "symbol string, ts timestamp, id bigint, bid double, ask double")
    assert {r["id"]: (r["bid"], r["ask"]) for r in stream_queries.drained(spark, data, made, "ts").collect()} == want
