"""Literal cases: dialects, through-fills, look-ahead, degenerate inputs, state machines, streams against batch."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import calendar, numeric
from barloom.operators import align, bars, carry, graph, labels, metrics, profile, signals
from barloom.operators import indicators as ind
from barloom.plans.registry import hourly, quotes, scored
from barloom.plans.stream_queries import drained
from barloom.sources import readers, writers
from barloom.streaming import streams

SF = "/root/testdata/sf0.001"


def at(text):
    return datetime.strptime(text, "%Y-%m-%d %H:%M:%S")


def test_tick_dialects(spark, tmp_path):
    head = "<DATE>{0}<TIME>{0}<BID>{0}<ASK>{0}<LAST>{0}<VOLUME>{0}<FLAGS>"
    lines = ["2024.01.02{0}00:00:00.000{0}0.61000{0}0.61020{0}{0}{0}6", "2024.01.02{0}00:00:00.250{0}{0}0.61040{0}{0}{0}4", "2024.01.02{0}00:00:01.000{0}0.61010{0}{0}{0}{0}2"]
    for sep, name in ((",", "comma"), ("\t", "tab")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "EURUSD_ticks.csv").write_text("\n".join(x.format(sep) for x in [head, *lines]))
        t = readers.scan_ticks(spark, str(tmp_path / name), sep=sep)
        got = bars.mid_spread(bars.tick_ffill(t)).orderBy("ts", "id").collect()
        assert [r["symbol"] for r in got] == ["EURUSD"] * 3 and got[-1]["flags"] == 2
        assert abs(got[0]["mid"] - 0.6101) < 1e-9 and got[2]["ask"] == 0.6104
        assert bars.bars_1s(bars.mid_spread(bars.tick_ffill(t))).orderBy("dt").first()["tk"] == 2
    (tmp_path / "col").mkdir()
    (tmp_path / "col" / "GBPUSD.csv").write_text("time_msc,time_sec,bid,ask,last,volume,volume_real,flags\n1704153600000,x,1.1,1.2,0,0,0,134\n")
    r = readers.scan_ticks(spark, str(tmp_path / "col")).first()
    assert (r["ts"], r["flags"]) == (at("2024-01-02 00:00:00"), 134)


def test_candle_tree(spark, tmp_path):
    d = tmp_path / "2024" / "Q1" / "BTCUSD.x"
    d.mkdir(parents=True)
    (d / "candles_M5.csv").write_text("bar_time,open,high,low,close,tick_volume,spread,real_volume\n2024.01.02 00:00:00,1,2,0.5,1.5,7,3,0\n2024.01.02 00:05:00,x,2,0.5,bad,7,3,0\n")
    alias = spark.createDataFrame([("BTCUSD.x", "BTCUSD")], "alias string, symbol string")
    rows = readers.scan_partitioned_tree(spark, str(tmp_path), alias).collect()
    assert [(r["symbol"], r["tf"], r["year"], r["quarter"], r["c"], r["tk"]) for r in rows] == [("BTCUSD", "M5", 2024, "Q1", 1.5, 7)]
    other = tmp_path / "2024" / "Q2" / "BTCUSD.x"
    other.mkdir(parents=True)
    (other / "candles_M5.csv").write_text("<CLOSE>,<LOW>,<HIGH>,<OPEN>,<TICKVOL>,<SPREAD>,<TIME>\n1.5,0.5,2,1,7,3,2024.04.02 00:00:00\n")
    both = readers.scan_partitioned_tree(spark, str(tmp_path)).orderBy("dt").collect()
    assert [(r["o"], r["h"], r["l"], r["c"], r["sp"], r["tk"]) for r in both] == [(1.0, 2.0, 0.5, 1.5, 3.0, 7)] * 2
    first = readers.scan_partitioned_tree(spark, str(tmp_path), start="2024-01-01", end="2024-03-31")
    assert [r["quarter"] for r in first.collect()] == ["Q1"] and readers.scan_partitioned_tree(spark, str(tmp_path), start="2030-01-01", end="2030-02-01").count() == 0
    (tmp_path / "plain.csv").write_text("2024-01-02 00:00,1,2,0.5,1.5,7,3\n")
    assert readers.scan_candles(spark, str(tmp_path / "plain.csv"), header=False).first()["tk"] == 7


def test_writers(spark, tmp_path):
    b = hourly(spark, SF)
    writers.sink_parquet(b, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == b.count()
    writers.sink_json(b, str(tmp_path / "j"))
    path = str(tmp_path / "q")
    writers.sink_quarterly_upsert(spark, b, path)
    writers.sink_quarterly_upsert(spark, b.limit(10).withColumn("c", F.lit(-1.0)), path)
    got = spark.read.parquet(path)
    assert got.count() == b.count() and got.where("c = -1").count() == 10
    assert {r["tf"] for r in writers.sink_feature_tables(b.withColumn("tf", F.lit("H1")), str(tmp_path / "f")).collect()} == {"H1"}
    micro = str(tmp_path / "m")
    b.unionByName(b).write.parquet(micro)
    assert readers.scan_micro_bars(spark, micro).count() == b.count()


def test_window_ends_before_anchor(spark):
    """The bar at the anchor itself is not seen."""
    m = [("A", at(f"2024-01-01 {t}"), 1.0, z, i, v) for t, z, i, v in (("00:59:58", 3.0, -0.5, 10.0), ("00:59:59", 7.0, 0.25, 11.0), ("01:00:00", 99.0, 99.0, 99.0))]
    micro = spark.createDataFrame(m, "symbol string, dt timestamp_ntz, tick_velocity double, spread_z double, bid_ask_imbalance double, price_velocity double")
    anchors = spark.createDataFrame([("A", at("2024-01-01 01:00:00")), ("B", at("2024-01-01 01:00:00"))], "symbol string, dt timestamp_ntz")
    a, b = align.interval_join_window(anchors, micro, 60).orderBy("symbol").collect()
    assert (a["n"], a["spread_z_last"], a["price_velocity_last"], a["spread_z_mean"], a["bid_ask_imbalance_abs_max"], a["tick_velocity_std"]) == (2, 7.0, 11.0, 5.0, 0.5, 0.0)
    assert [b[c] for c in align.MICRO] == [0.0] * 7


def test_fill_must_trade_through(spark):
    """A buy two pips below 1.1000: a low at the limit is a near miss, one a pip below it a fill."""
    m = [("EURUSD", at("2024-01-01 01:00:00"), 1.1, 1.1001, 1.0998, 1.1), ("EURUSD", at("2024-01-01 01:00:01"), 1.1, 1.1001, 1.0997, 1.1)]
    micro = spark.createDataFrame(m, "symbol string, dt timestamp_ntz, o double, h double, l double, c double")
    e = spark.createDataFrame([(1, "EURUSD", at("2024-01-01 01:00:00"), 1, 0.001), (2, "EURUSD", at("2024-01-01 02:00:00"), 1, 0.001)], "event_id int, symbol string, dt timestamp_ntz, direction int, atr double")
    pip = F.lit(0.0001 - 1e-12)  # the lows lie on the limits
    one, two = ({(r["event_id"], r["action"]): r for r in align.first_fill_join(e, micro, n, pip).collect()} for n in (1, 2))
    limit = one[1, "limit_2tick"]
    assert (limit["filled"], limit["no_fill"], limit["near_miss"], limit["reward"]) == (False, True, True, -2.5e-5)
    assert two[1, "limit_2tick"]["filled"] and two[1, "limit_2tick"]["fill_price"] == pytest.approx(1.0998)
    assert two[1, "limit_2tick"]["mae"] == pytest.approx(0.0001) and two[1, "limit_2tick"]["mfe"] == pytest.approx(0.0003)
    assert two[1, "limit_2tick"]["reward"] == pytest.approx(0.0002 + 0.25 * 0.0003 - 0.1 * 0.0001)
    assert one[1, "reject_wait"]["reward"] == -5e-5 and not one[1, "reject_wait"]["no_fill"]
    market = one[1, "market_now"]
    assert market["filled"] and market["fill_price"] == pytest.approx(1.1001) and market["slippage"] == pytest.approx(1e-4)
    assert (one[2, "market_now"]["filled"], one[2, "market_now"]["no_fill"], one[2, "market_now"]["reward"]) == (False, True, 0.0)


def test_no_look_ahead(spark):
    b = hourly(spark, SF)
    cut = b.agg(F.percentile_approx(F.unix_seconds(F.col("dt").cast("timestamp")), 0.6)).first()[0]
    early = F.unix_seconds(F.col("dt").cast("timestamp")) <= cut
    full, part = (ind.opening_range(ind.pair_features_16(x, F.lit(1e-4)).withColumns({"real": F.lit(True), "s": F.hour("dt") % 3}), "s") for x in (b, b.where(early)))
    assert sorted(map(str, full.where(early).collect())) == sorted(map(str, part.collect()))


def test_hysteresis_positions(spark):
    p = [0.75, 0.75, 0.50, 0.75, 0.50]
    rows = [("A", at(f"2024-01-01 00:00:0{i}"), x, 1 - x) for i, x in enumerate(p)]
    df = spark.createDataFrame(rows, "symbol string, dt timestamp_ntz, b double, s double")
    got = [r["position"] for r in signals.hysteresis(df, "b", "s", 0.6, 0.52, 0.12).orderBy("dt").collect()]
    assert got == [1, 1, 0, 1, 0]


def test_hysteresis_long_holds(spark):
    """Probabilities that do not add up to 1, and walks that stay above the lower bound for long."""
    rng, rows, want = np.random.default_rng(3), [], []
    for k in range(12):
        n = 300
        b, s = rng.random(n), rng.random(n)
        if k % 2:
            b, s = np.clip(0.55 + 0.015 * np.cumsum(rng.normal(0, 1, n)), 0, 1), np.clip(rng.normal(0.56, 0.03, n), 0, 1)
        state = 0
        for i, (x, y) in enumerate(zip(b.tolist(), s.tolist(), strict=True)):
            if state == 0:
                state = 1 if x >= 0.6 else -1 if y >= 0.6 else 0
                if x >= 0.6 and y >= 0.6:
                    state = 1 if x >= y else -1
            elif (x if state == 1 else y) < 0.52:
                state = 0
            rows.append((f"s{k}", at("2024-01-01 00:00:00") + timedelta(minutes=i), x, y))
            want.append(state)
    df = spark.createDataFrame(rows, "symbol string, dt timestamp_ntz, b double, s double")
    got = {(r["symbol"], r["dt"]): r["position"] for r in signals.hysteresis(df, "b", "s").collect()}
    assert [got[r[0], r[1]] for r in rows] == want


def test_hysteresis_against_loop(spark):
    s = scored(spark, SF).withColumn("q", 1 - F.col("p"))
    got = {(r["symbol"], r["id"]): r["position"] for r in signals.hysteresis(s, "p", "q", 0.8, 0.3).collect()}
    state, want = {}, {}
    for r in s.orderBy("dt", "id").collect():
        x = state.get(r["symbol"], 0)
        if x == 0:
            x = 1 if r["p"] >= 0.8 else -1 if r["q"] >= 0.8 else 0
        elif (x == 1 and r["p"] < 0.3) or (x == -1 and r["q"] < 0.3):
            x = 0
        state[r["symbol"]] = want[r["symbol"], r["id"]] = x
    assert got == want


def test_exposure_cap(spark):
    rows = [(1, "EURUSD", 5.0), (1, "GBPUSD", 4.0), (1, "USDJPY", 3.0), (1, "AUDNZD", 1.0)]
    got = signals.exposure_cap(spark.createDataFrame(rows, "dt int, symbol string, score double"), "score", 2)
    assert {r["symbol"] for r in got.collect()} == {"EURUSD", "GBPUSD", "AUDNZD"}


def _bars_of(spark, high, low, close, atr):
    rows = [("A", i, float(h), float(lo), float(c), float(atr)) for i, (h, lo, c) in enumerate(zip(high, low, close, strict=True))]
    return spark.createDataFrame(rows, "symbol string, dt int, h double, l double, c double, atr double")


def _last_profile(spark, high, low, close, atr, **named):
    """dt counts bars, so its unit is a second."""
    b = _bars_of(spark, high, low, close, atr).withColumn("dt", F.timestamp_seconds("dt").cast("timestamp_ntz"))
    return profile.tpo_profile(b, "atr", **named).orderBy(F.col("dt").desc()).first()


def test_profile_bounds_and_degenerate_atr(spark):
    c = np.linspace(1.095, 1.105, 60)
    p = _last_profile(spark, c + 0.0008, c - 0.0008, c, 0.0015, lookback=48, bins=16)
    assert p.val <= p.poc <= p.vah and p.low <= p.poc <= p.high and 0 < p.balance < 1
    flat = _last_profile(spark, c + 1, c - 1, c, 1e-7)
    assert flat.degenerate and (flat.poc, flat.vah, flat.val, flat.low, flat.high) == (c[-1],) * 5 and (flat.balance, flat.dist_poc, flat.width) == (0.0, 0.0, 0.0)
    assert _last_profile(spark, np.ones(5), np.ones(5), np.ones(5), 0.1).balance == 1.0
    # bars 0-1, 1-2 and 1-3 over three bins of width 1: an upper edge is not in the bin above it
    edges = _last_profile(spark, [1.0, 2.0, 3.0], [0.0, 1.0, 1.0], [0.5, 1.5, 2.5], 1.0, bins=3)
    assert (edges.poc, edges.val, edges.vah, edges.balance) == (1.5, 1.0, 3.0, 0.5)


def test_profiles_against_counting(spark):
    """Random bars: counts bin by bin, the area by trying the two neighbours in turn."""
    rng = np.random.default_rng(5)
    c = 10 + np.cumsum(rng.normal(0, 0.3, 90))
    h, low = c + rng.random(90), c - rng.random(90)
    b = _bars_of(spark, h, low, c, 0.4).withColumn("dt", F.timestamp_seconds("dt").cast("timestamp_ntz"))
    for i, r in enumerate(profile.tpo_profile(b, "atr", 30, 12).orderBy("dt").collect()):
        w = slice(max(0, i - 29), i + 1)
        edges = np.linspace(low[w].min(), h[w].max(), 13)
        n = [int(((low[w] < edges[k + 1]) & (h[w] > edges[k])).sum()) for k in range(12)]
        area = [n.index(max(n))]
        while sum(n[k] for k in area) < 0.7 * sum(n):
            near = [k for k in (max(area) + 1, min(area) - 1) if 0 <= k < 12]
            area.append(max(near, key=lambda k: n[k]))  # the first, upper one at ties
        assert r["val"] == pytest.approx(edges[min(area)]) and r["vah"] == pytest.approx(edges[max(area) + 1]) and r["balance"] == pytest.approx(max(n) / sum(n))


def test_memory_scores(spark):
    c = np.concatenate([np.full(40, 10.0), np.full(12, 8.0)])
    b = _bars_of(spark, c + 0.1, c - 0.1, c, 0.5).withColumn("dt", F.timestamp_seconds("dt").cast("timestamp_ntz"))
    m = profile.tpo_memory(b, "atr", (24, 48)).orderBy(F.col("dt").desc()).first()
    assert m.tpo_resistance_score == 0.0 and 0 <= m.tpo_support_score <= 1 and 0 <= m.tpo_value_area_overlap <= 1
    short = profile.tpo_memory(b, "atr", (24, 48)).orderBy("dt").first()
    assert (short.tpo_value_area_overlap, short.tpo_rejection_score, short.tpo_balance_score > 0) == (1.0, 0.0, True)


def test_tpo_memory_zeros(spark):
    b = hourly(spark, SF).withColumn("atr", F.lit(1e-7))
    r = profile.tpo_memory(b, "atr").agg(*(F.max(F.abs(c)) for c in ("tpo_support_score", "tpo_poc_drift_atr", "tpo_value_area_width_atr"))).first()
    assert tuple(r) == (0.0, 0.0, 0.0)


def test_reversal_buys_after_a_dip(spark):
    rise, dip = np.linspace(1.0950, 1.1050, 50), np.array([1.1048, 1.1035, 1.1020, 1.1000, 1.0905, 1.0912])
    c = np.concatenate([rise, dip])
    rows = [("A", i, float(x), float(x) + 3e-4, float(x) - 3e-4, 8e-5) for i, x in enumerate(c)]
    b = spark.createDataFrame(rows, "symbol string, dt int, c double, h double, l double, sp double").withColumns({"atr": F.lit(0.0012), "n": F.col("dt") + 1, "other_direction": F.lit(0), "other_confidence": F.lit(0.0)})
    b = b.withColumn("dt", F.timestamp_seconds("dt").cast("timestamp_ntz"))
    b = profile.tpo_memory(ind.log_ret(b, 1).withColumn("ret_3", F.lit(0.01)), "atr")
    decide = lambda rows: signals.reversal_decision(rows).orderBy(F.col("dt").desc()).first()
    r = decide(b)
    assert (r["direction"], r["reason"]) == (1, "") and r["tpo_support_score"] > 0 and 0.16 < r["confidence"] <= 0.96 and 0.45 <= r["lots"] <= 1.35
    assert decide(b.withColumn("other_confidence", F.lit(0.2)))["reason"] == "legacy_high_confidence"
    assert decide(b.withColumn("sp", F.lit(0.001)))["reason"] == "spread_stress"
    blocked = decide(b.withColumns({"other_direction": F.lit(-1), "other_confidence": F.lit(0.12)}))
    assert (blocked["direction"], blocked["confidence"], blocked["reason"]) == (0, 0.0, "legacy_direction_conflict")


def test_votes_gates_and_scales(spark):
    one = spark.range(1)
    value = lambda column: one.select(column.alias("x")).first()["x"]
    up = dict(rsi=62, macd=0.5, pct_b=0.7, stoch_k=65, cci=80, will_r=-30, mom5=0.5)
    down = dict(rsi=35, macd=-0.3, pct_b=0.3, stoch_k=30, cci=-70, will_r=-70, mom5=-0.5)
    votes = lambda d: numeric.indicator_votes({k: F.lit(v) for k, v in d.items()})
    assert (value(votes(up)), value(votes(down)), value(votes({**up, "rsi": None}))) == (7, -7, 6)
    assert [value(numeric.vote_direction(F.lit(v))) for v in (7, 3, 2, -2, -3)] == [1, 1, 0, 0, -1]
    proxy = lambda v, r, s: round(value(numeric.confidence_proxy(F.lit(v), F.lit(r), F.lit(s))), 6)
    assert (proxy(7, 1.0, 10), proxy(-7, -2.5e-4, 2), proxy(0, 0.0, 3)) == (0.825, 0.575, 0.075)
    gate = lambda t, r: value(calendar.bridge_gate(F.lit(at(t)).cast("timestamp_ntz"), F.lit(r)))
    assert [round(gate(f"2024-01-02 {h:02d}:00:00", 0), 3) for h in (23, 3, 10, 15, 1)] == [0.5, 0.6, 0.8, 1.0, 0.4]
    assert [round(gate("2024-01-02 15:00:00", r), 3) for r in (2, 3, 4)] == [1.0, 0.7, 0.3] and gate("2024-01-06 15:00:00", 0) == 0.0
    assert [value(numeric.regime_scale_of_code(F.lit(c))) for c in (1, 2, 3, 4)] == [1.0, 0.75, 0.55, 0.35]
    regime = lambda b0, b1, h1: value(graph.regime_class(F.lit(b0), F.lit(b1), F.lit(h1), 35))
    assert [regime(21, 9, 1.0), regime(20, 9, 0.9), regime(1, 5, 0.5), regime(1, 1, 0.1), regime(1, 4, 0.1)] == ["FRAGMENTED", "HIGH_STRESS", "TRANSITIONAL", "LOW_VOL", "NORMAL"]
    assert value(calendar.slot_id(F.lit(at("2024-01-02 03:17:00")).cast("timestamp_ntz"))) == 288 + 36 + 3


def test_spectrum_of_small_graphs():
    pair = np.array([[0.0, 1.0], [1.0, 0.0]])
    assert np.allclose(graph.spectrum_of(pair), (2.0, 1, 0, 0.0, 2.0))
    assert graph.spectrum_of(np.kron(np.eye(2), pair))[1] == 2
    assert graph.spectrum_of(np.zeros((3, 3)))[1] == 1


def test_entry_direction_needs_spread(spark):
    d = lambda p, **k: spark.range(1).select(signals.entry_direction(F.lit(p), F.lit(0.0), **k).alias("x")).first()["x"]
    assert [d(0.7), d(0.3), d(0.6)] == [1, -1, 0] and d(0.57, base=0.5) == 0 and d(0.58, base=0.5) == 1 and d(0.7, cap=0.69) == 0


def test_laggards_against_numpy(spark):
    rng = np.random.default_rng(3)
    r = rng.normal(0, 0.01, (20, 3))
    rows = [("abc"[j], i, float(r[i, j])) for i in range(20) for j in range(3)]
    got = {x["symbol"]: x for x in graph.laggard_features(spark.createDataFrame(rows, "symbol string, dt int, ret double")).where("dt = 19").collect()}
    corr = 0.85 * np.corrcoef(r.T)
    np.fill_diagonal(corr, 0)
    rms = lambda k: np.sqrt((r[-k:] ** 2).mean(axis=0))
    ratio, mom, deg = rms(6) / rms(12), r[-3:].sum(axis=0) / (rms(12) * 3**0.5), np.abs(corr).sum(axis=1)
    nv, nm = np.abs(corr) @ ratio / deg, corr @ mom / deg
    for j, s in enumerate("abc"):
        want = (nm[j], mom[j] - nm[j], nv[j], nv[j] - ratio[j], max(nv[j] - ratio[j], 0) * min(abs(nm[j]), 3), deg[j] / 2)
        assert np.allclose([got[s][c] for c in ("nb_momentum", "momentum_residual", "nb_volatility", "vol_laggard", "laggard_score", "strength")], want)


def test_zeros_and_equal_folds_divide_safely(spark):
    zero = spark.createDataFrame([("A", at(f"2024-01-01 00:{i:02d}:00"), x, x, x, x, 0.0, 1) for i, x in enumerate([0.0, 0.0, 1.0, 0.0, 2.0] * 5)], "symbol string, dt timestamp_ntz, o double, h double, l double, c double, sp double, tk int")
    for f in (lambda b: ind.pair_features_16(b, F.lit(1e-4)), ind.session_local_features, ind.regime_signal, ind.microstructure_4, labels.forward_return, lambda b: labels.label_threshold(b, 3, 0.1), lambda b: ind.horizon_return(b, 2)):
        assert f(zero).count() == len(f(zero).collect()) == 25
    folds = spark.createDataFrame([("a", i, 1.0, 1.0) for i in range(4)], "config string, fold int, loss double, score double")
    assert metrics.fold_summary(folds).first()["dispersion"] == 0.0 and metrics.pbo_cscv(folds).first()["n_splits"] == 6


def test_class_scores(spark):
    df = spark.createDataFrame([(0.7, 0.2, 0.1, 0), (0.2, 0.5, 0.3, 2)], "a double, b double, c double, y int")
    r = metrics.classification_of(df, ["a", "b", "c"]).first()
    assert abs(r["log_loss"] + (np.log(0.7) + np.log(0.3)) / 2) < 1e-9 and abs(r["brier"] - (0.14 + 0.78) / 6) < 1e-9
    assert r["accuracy"] == 0.5 and abs(r["ece"] - (0.3 + 0.5) / 2) < 1e-9


def test_stream_and_batch_positions_agree(spark):
    """Both sides at the entry mark: the one that leads by the edge is taken, in both forms."""
    rows = [("A", at(f"2024-01-01 00:00:0{i}"), b, s) for i, (b, s) in enumerate([(0.65, 0.72), (0.65, 0.5), (0.5, 0.5), (0.7, 0.7), (0.75, 0.6)])]
    df = spark.createDataFrame(rows, "symbol string, dt timestamp_ntz, p_buy double, p_sell double")
    batch = [r["position"] for r in signals.hysteresis(df, "p_buy", "p_sell", edge=0.05).orderBy("dt").collect()]
    live = drained(spark, df.withColumn("dt", F.col("dt").cast("timestamp")), lambda s: streams.stream_hysteresis(s, edge=0.05))
    assert [r["position"] for r in live.orderBy("dt").collect()] == batch == [-1, 0, 0, 0, 1]


def test_folds_expand_over_blocks(spark):
    b = spark.createDataFrame([("A", at(f"2024-01-{d:02d} 00:00:00"), d // 5 if d < 20 else None) for d in range(1, 25)], "symbol string, dt timestamp_ntz, blk int")
    f = labels.folds_expanding(b, F.col("blk"), 2, purge=2)
    got = {(r["fold"], r["part"]): (r["first"].day, r["last"].day, r["times"]) for r in labels.folds_metadata(f).collect()}
    assert got == {(0, "train"): (1, 7, 7), (0, "valid"): (10, 14, 5), (1, "train"): (1, 12, 12), (1, "valid"): (15, 19, 5)}


def test_triple_barrier_buys(spark):
    c = [1.0] * 16 + [1.0 + 0.01 * k for k in range(1, 8)]
    rows = [("A", at(f"2024-01-01 00:{i:02d}:00"), x, x + 0.005, x - 0.002, x, 1e-4, 0.01) for i, x in enumerate(c)]
    b = spark.createDataFrame(rows, "symbol string, dt timestamp_ntz, o double, h double, l double, c double, sp double, atr double")
    assert labels.label_triple_barrier(b, 3, "atr", F.lit(1e-4)).where("barrier_valid and label = 1").count() > 0


def test_folds_are_purged(spark):
    f = labels.folds_walkforward(hourly(spark, SF), "week", purge=5)
    ends = f.groupBy("fold", "part").agg(F.min("dt").alias("a"), F.max("dt").alias("z")).collect()
    by = {(r["fold"], r["part"]): (r["a"], r["z"]) for r in ends}
    assert all(by[k, "train"][1] < by[k, "valid"][0] for k, p in by if p == "valid" and (k, "train") in by)


def test_stream_equals_batch(spark):
    q = quotes(spark, SF).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "id", "mid")
    got = {(r["symbol"], r["dt"].replace(tzinfo=None)): r["c"] for r in drained(spark, q, streams.stream_bars).collect()}
    want = {(r["symbol"], r["dt"]): r["c"] for r in hourly(spark, SF).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) < 15


def test_pbo_needs_even_folds(spark):
    df = spark.createDataFrame([("a", i, 1.0, 1.0) for i in range(3)], "config string, fold int, loss double, score double")
    with pytest.raises(ValueError):
        metrics.pbo_cscv(df)


def test_asof_clamp(spark):
    left = spark.createDataFrame([("A", at("2024-01-01 00:00:00")), ("A", at("2024-01-03 00:00:00"))], "symbol string, dt timestamp_ntz")
    right = spark.createDataFrame([("A", at("2024-01-02 00:00:00"), 5.0)], "symbol string, dt timestamp_ntz, x double")
    value = lambda clamp: [r["x"] for r in align.asof_backward(left, right, ["x"], clamp).orderBy("dt").collect()]
    assert value(False) == [None, 5.0] and value(True) == [5.0, 5.0]


def test_first_fill_join_sees_sparse_bars(spark):
    """The first five bars count, however late; an event on a bar meets that bar. The limit, half an ATR behind, is 5."""
    micro = spark.sql("SELECT 'a' AS symbol, TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 5 * id) AS dt, 9.5D AS o, 10.0D + id AS h, 9.0D - id AS l, 9.5D AS c FROM range(8)")
    events = spark.sql("SELECT id AS event_id, 'a' AS symbol, TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, 1.0 * id) AS dt, 1 AS direction, 9.0D AS atr FROM VALUES (0L), (1L), (200000L) AS t(id)")
    rows = align.first_fill_join(events, micro, 5, F.lit(0.01)).where("action = 'limit_half_atr'").collect()
    got = {r["event_id"]: (r["near_miss"], r["filled"], r["fill_dt"] and r["fill_dt"].hour) for r in rows}
    assert got == {0: (True, False, None), 1: (False, True, 1), 200000: (False, False, None)}


def test_carry_across_buckets(spark):
    """Values pass over day bounds, empty days and leading gaps; numbers go on from day to day. Held to a loop."""
    rng = random.Random(5)
    rows = [(s, datetime(2024, 1, 1) + timedelta(hours=7 * i + rng.randrange(5)), rng.choice([None, None, float(i)])) for s in "ab" for i in range(40) if i % 11 < 7]
    df = spark.createDataFrame(rows, "symbol string, dt timestamp_ntz, x double")
    got = carry.carry(carry.numbered(df, "no", [F.col("dt")]), [F.col("dt")], past={"back": F.col("x")}, ahead={"next": F.col("x")})
    found = {(r["symbol"], r["dt"]): (r["no"], r["back"], r["next"]) for r in got.collect()}
    want = {}
    for s in "ab":
        mine = sorted(r[1:] for r in rows if r[0] == s)
        for i, (t, _) in enumerate(mine):
            back = [x for _, x in mine[: i + 1] if x is not None]
            ahead = [x for _, x in mine[i:] if x is not None]
            want[s, t] = (i + 1, back[-1] if back else None, ahead[0] if ahead else None)
    assert found == want
    assert carry.carry(df.limit(0), [F.col("dt")], past={"x": F.col("x")}).count() == 0


def test_gates_by_their_limits(spark):
    one = spark.range(1)
    of = lambda d, q, p: one.select(*(x.alias(n) for n, x in zip(("ok", "conf"), signals.entry_gate(F.lit(d), F.lit(q).cast("double"), F.lit(p)), strict=True))).first()
    assert tuple(of(1, 0.7, 0.9)) == (True, 0.7) and tuple(of(1, None, 0.9)) == (True, 0.9) and of(1, 0.49, 0.9)["ok"] is False
    assert of(-1, 0.2, 0.1)["conf"] == pytest.approx(0.8) and of(-1, 0.6, 0.1)["ok"] is False and tuple(of(0, 0.9, 0.5)) == (False, None)
    row = dict(net=0.15, confidence=0.55, trend=0.1, direction=1, atr_ratio=2.8, agreement=0.5, regime="NORMAL", gap=0.0041)
    gate = lambda **x: signals.six_gates(one.select(*(F.lit(v).alias(k) for k, v in {**row, **x}.items()))).first()["all_pass"]
    assert gate() and not any(gate(**x) for x in ({"net": 0.14}, {"confidence": 0.54}, {"trend": -0.1}, {"direction": 0}, {"atr_ratio": 2.9}, {"atr_ratio": 0.29}, {"agreement": 0.4}, {"regime": "FRAGMENTED"}, {"gap": 0.004}))


def test_both_barriers_in_one_bar(spark):
    """Both touched and a close at the entry: up. No touch at all is no row of the binary form."""
    flat = [("EURUSD", at("2024-01-01 00:00:00") + timedelta(hours=i), 1.0, 1.0, 1.0, 0.0, 0.001) for i in range(16)]
    both = [("EURUSD", at("2024-01-01 16:00:00") + timedelta(hours=i), 1.01, 0.99, 1.0, 0.0, 0.001) for i in range(1)] + [("EURUSD", at("2024-01-01 17:00:00") + timedelta(hours=i), 1.0, 1.0, 1.0, 0.0, 0.001) for i in range(8)]
    b = spark.createDataFrame(flat + both, "symbol string, dt timestamp_ntz, h double, l double, c double, sp double, atr double")
    got = {r["dt"].hour: (r["label"], r["barrier_valid"]) for r in labels.label_triple_barrier(b, 6, "atr", F.lit(1e-4)).where("dt < timestamp'2024-01-02'").collect()}
    assert got[15] == (1, True) and got[16] == (0, False) and got[9] == (0, False) and got[14] == (1, True)


def test_net_direction_rules_agreement(spark):
    rows = [(1, "a", 0.5, 0.9), (1, "b", 0.5, 0.1), (1, "c", -0.5, 0.9), (2, "a", 0.5, 0.9), (2, "b", -0.5, 0.9), (3, "a", 0.5, 0.1)]
    got = {r["dt"]: r["agreement"] for r in graph.agreement_ratio(spark.createDataFrame(rows, "dt int, symbol string, residual double, confidence double"), 0.5).collect()}
    assert got == {1: 0.5, 2: 0.0, 3: 0.0}


def test_deflated_sharpe_and_efficiency(spark):
    import math

    from barloom.operators import metrics

    f = spark.createDataFrame([("x", i, s, 0.5, 100) for i, s in enumerate((0.1, 0.3, 0.2))] + [("y", 0, 0.3, 1.0, 1)], "config string, fold int, score double, loss double, n int")
    got = {r["config"]: r["dsr"] for r in metrics.dsr(f).collect()}
    z = (0.3 - 0.0837) * math.sqrt(99) / math.sqrt(1 - 0.25 * 0.09)
    assert got["y"] == 0.5 and got["x"] == pytest.approx(0.5 * (1 + math.erf(z / math.sqrt(2))), abs=0.01)
    assert {r["config"]: r["wfe"] for r in metrics.wfe(f).collect()} == {"x": 0.3, "y": 0.6}


def test_kelly_within_bounds(spark):
    from barloom.operators import metrics

    rows = spark.createDataFrame([(i, p) for i, p in enumerate((0.57, 0.61, 0.53, 0.9, 0.1, 0.5))], "i int, p double")
    s = metrics.kelly_stakes(rows, "p", 0.05, 1.5, cap=0.1).orderBy("i").collect()
    assert [r["side"] for r in s] == [1, 1, 0, 1, -1, 0] and all(0 <= r["stake"] <= 0.1 for r in s)
    assert s[0]["stake"] == pytest.approx((1.5 * 0.57 - 0.43) / 1.5 * 0.25) and s[3]["stake"] == s[4]["stake"] == 0.1


@pytest.mark.parametrize("few", [5, 200])
def test_exact_quantiles(spark, few):
    """Ties, outliers of many sizes, a group of one, null keys, nulls and NaN; few forces many passes."""
    from barloom.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(7)
    rows = [("a", float(x)) for x in 10.0 ** rng.integers(-300, 300, 400)] + [("b", float(x)) for x in rng.integers(0, 4, 300)] + [("c", 7.5)] + [(None, float(x)) for x in rng.normal(0, 1, 250)] + [("b", None), ("d", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.77, 1.0]
    got = {r["k"]: list(r)[1:] for r in exact_quantiles(df, ["k"], "x", shares, few).collect()}
    assert set(got) == {"a", "b", "c", None}
    for k in got:
        x = np.array([v for q, v in rows if q == k and v is not None and v == v])
        assert np.allclose(got[k], np.quantile(x, shares), rtol=1e-12, atol=0)
    assert exact_quantiles(df.limit(0), ["k"], "x", [0.5]).collect() == []
