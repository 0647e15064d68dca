"""Joins and alignment of many symbols on one timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import pip_size
from barloom.operators.carry import carry, numbered

PRICES = ["o", "h", "l", "c"]


def _past() -> Window:
    return Window.partitionBy("symbol").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)


def _ahead() -> Window:
    return Window.partitionBy("symbol").orderBy("dt").rowsBetween(0, Window.unboundedFollowing)


def union_timeline(b: DataFrame) -> DataFrame:
    return b.select("dt").distinct()


def intersect_timeline(b: DataFrame) -> DataFrame:
    """Times at which every symbol of b has a bar."""
    total = b.select(F.count_distinct("symbol").alias("n"))
    return b.groupBy("dt").agg(F.count_distinct("symbol").alias("m")).join(F.broadcast(total), F.col("m") == F.col("n")).select("dt")


def _on(timeline: DataFrame, symbols: DataFrame, b: DataFrame) -> DataFrame:
    """A row for each time and symbol of two key lists; symbols is a dimension table."""
    grid = timeline.join(F.broadcast(symbols.select("symbol").distinct()))
    full = grid.join(b, ["symbol", "dt"], "left")
    return full.withColumns({"real": F.col("c").isNotNull(), "sp": F.coalesce("sp", F.lit(0.0)), "tk": F.coalesce("tk", F.lit(0))})


def align_union(b: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each symbol at each time any symbol has; prices null and real false where it has no bar."""
    return _on(union_timeline(b), symbols, b)


def align_union_ffill(b: DataFrame, symbols: DataFrame) -> DataFrame:
    """align_union with prices carried forward, from each symbol's first bar."""
    full = align_union(b, symbols)
    return carry(full, [F.col("dt")], past={p: F.col(p) for p in PRICES}).where("c is not null")


def align_calendar_mask(b: DataFrame, symbols: DataFrame, step: str) -> DataFrame:
    """Each symbol at each step from the first bar to the last; prices stay null where it has none."""
    ends = b.agg(F.min("dt").alias("a"), F.max("dt").alias("z"))
    return _on(ends.select(F.explode(F.sequence("a", "z", F.expr(f"INTERVAL {step}"))).alias("dt")), symbols, b)


def align_carry(aligned: DataFrame) -> DataFrame:
    """Prices carried forward, then backward over leading gaps; real tells which rows had a bar."""
    both = carry(aligned, [F.col("dt")], past={f"__l_{p}": F.col(p) for p in PRICES}, ahead={f"__n_{p}": F.col(p) for p in PRICES})
    return both.select(*(F.coalesce(f"__l_{c}", f"__n_{c}").alias(c) if c in PRICES else F.col(c) for c in aligned.columns))


def align_intersect(b: DataFrame) -> DataFrame:
    return b.join(intersect_timeline(b), "dt", "left_semi")


def interpolate_linear(aligned: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls filled linearly by row position; leading and trailing ones take the nearest value."""
    rn = Window.partitionBy("symbol").orderBy("dt")
    rows = aligned.withColumn("__rn", F.row_number().over(rn))
    out = rows
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col("__rn").alias("i"), F.col(c).alias("x")))
        a, z = F.last(known, ignorenulls=True).over(_past()), F.first(known, ignorenulls=True).over(_ahead())
        out = out.withColumns({f"__a_{c}": a, f"__z_{c}": z})
    made = {}
    for c in columns:
        a, z = F.col(f"__a_{c}"), F.col(f"__z_{c}")
        line = a["x"] + (z["x"] - a["x"]) * F.try_divide(F.col("__rn") - a["i"], z["i"] - a["i"])
        made[c] = F.coalesce(F.col(c), line, a["x"], z["x"])
    return out.withColumns(made).drop("__rn", *(f"__{s}_{c}" for s in "az" for c in columns))


def asof_backward(left: DataFrame, right: DataFrame, columns: list[str], clamp: bool = False) -> DataFrame:
    """left (symbol, dt, ...) with right's columns from its last row at or before dt.

    One shuffle by symbol and day for both sides, whatever their sizes. With clamp,
    times before right's first row take that row (which looks ahead); otherwise null.
    """
    marks = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in ("symbol", "dt")]
    value = F.struct(*columns)
    kind = right.select(value.alias("v")).schema["v"].dataType
    both = left.withColumns({"__right": F.lit(False), "__v": F.lit(None).cast(kind)}).unionByName(right.select("symbol", "dt", *marks, F.lit(True).alias("__right"), value.alias("__v")))
    order = [F.col("dt"), (~F.col("__right")).alias("__left")]  # right's rows first at equal times
    found = carry(both, order, past={"__got": F.col("__v")}, ahead={"__next": F.col("__v")} if clamp else None).where("not __right")
    got = F.coalesce("__got", "__next") if clamp else F.col("__got")
    return found.select(*left.columns, *(got[c].alias(c) for c in columns))


def pair_self_join(rows: DataFrame, value: str) -> DataFrame:
    """(dt, a, b, x, y) for each pair a < b of symbols present at dt: an equi-join on dt."""
    a = rows.select("dt", F.col("symbol").alias("a"), F.col(value).alias("x"))
    b = rows.select("dt", F.col("symbol").alias("b"), F.col(value).alias("y"))
    return a.join(b, "dt").where("a < b")


#: Features of interval_join_window, in order.
MICRO = "tick_velocity_mean tick_velocity_std spread_z_mean spread_z_last bid_ask_imbalance_mean bid_ask_imbalance_abs_max price_velocity_last".split()


def interval_join_window(anchors: DataFrame, micro: DataFrame, seconds: int = 60) -> DataFrame:
    """anchors (symbol, dt) with n and the seven features of MICRO of the micro bars in [anchor - seconds, anchor); none gives zeros.

    micro: (symbol, dt, tick_velocity, spread_z, bid_ask_imbalance,
    price_velocity), nulls counting as 0. A range join by buckets of the
    window's length: an anchor meets the two buckets its window can touch, so
    the join is an equi-join.
    """
    bucket = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / seconds)
    of = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    m = micro.select("symbol", F.col("dt").alias("__t"), *map(of, ("tick_velocity", "spread_z", "bid_ask_imbalance", "price_velocity")), bucket(F.col("dt")).alias("__b"))
    a = anchors.select("symbol", "dt").distinct().withColumn("__b", F.explode(F.array(bucket(F.col("dt")) - 1, bucket(F.col("dt")))))
    near = a.join(m, ["symbol", "__b"]).where((F.col("__t") < F.col("dt")) & (F.col("__t") >= F.col("dt") - F.expr(f"INTERVAL {seconds} SECONDS")))
    made = [
        F.avg("tick_velocity"), F.stddev_pop("tick_velocity"), F.avg("spread_z"), F.max_by("spread_z", "__t"), F.avg("bid_ask_imbalance"), F.max(F.abs("bid_ask_imbalance")), F.max_by("price_velocity", "__t")
    ]
    summed = near.groupBy("symbol", "dt").agg(F.count("*").alias("n"), *(c.alias(n) for n, c in zip(MICRO, made, strict=True)))
    return anchors.join(summed, ["symbol", "dt"], "left").withColumns({"n": F.coalesce("n", F.lit(0))} | {c: F.coalesce(c, F.lit(0.0)) for c in MICRO})


# An order's actions by number; what waiting and an unfilled limit cost; weights of the best and worst price after a fill.
ACTIONS = ("reject_wait", "market_now", "limit_2tick", "limit_3tick", "limit_half_atr", "passive_limit_1tick")
WAIT_REWARD, UNFILLED_REWARD, BEST_WEIGHT, WORST_WEIGHT = -5e-5, -2.5e-5, 0.25, 0.1


def first_fill_join(events: DataFrame, micro: DataFrame, bars_ahead: int = 10, pip: Column | None = None, atr_slip: float = 0.01, pip_slip: float = 1.0) -> DataFrame:
    """What each action would have given for each event: a row an event and action.

    events: (event_id, symbol, dt, direction, atr); micro: (symbol, dt, o, h, l, c).
    The first bars_ahead bars at or after the event count; the first one's open
    is the price a market order slips from, by the greater of atr_slip ATR and
    pip_slip pips, and limits lie 2, 3 or 1 pips or half an ATR behind. A limit
    is filled by the first bar that trades through it by a pip, and is a near
    miss if some bar came within a pip and none went through. After the fill
    (that bar included) mfe and mae are the farthest price for and against the
    order, and the reward the last close's gain plus a quarter of mfe less a
    tenth of mae. Waiting and unfilled limits have fixed rewards; without bars
    nothing is filled and the reward is 0.

    The bars of a symbol are numbered by time, so an event meets exactly its
    bars_ahead ones by an equi-join on the number; they are put into one short
    array, which the six actions fold over.
    """
    m = numbered(micro.select("symbol", F.col("dt").alias("t"), "o", "h", "l", "c"), "__no", [F.col("t")], time="t")
    e = asof_backward(events.select("event_id", "symbol", "dt"), m.select("symbol", F.col("t").alias("dt"), F.col("t").alias("__t"), F.col("__no").alias("__last")), ["__t", "__last"])
    begin = F.when(F.col("__t") == F.col("dt"), F.col("__last")).otherwise(F.coalesce("__last", F.lit(0)) + 1)
    e = e.withColumn("__no", F.explode(F.sequence(begin, begin + (bars_ahead - 1)))).drop("__t", "__last")
    seen = e.join(m, ["symbol", "__no"]).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("__no", "t", "o", "h", "l", "c"))).alias("bars"))
    number = {n: i for i, n in enumerate(ACTIONS)}
    rows = events.join(seen, "event_id", "left").withColumn("action", F.explode(F.array(*map(F.lit, range(len(ACTIONS))))))
    pip = pip_size(F.col("symbol")) if pip is None else pip
    side, first, act = F.when(F.col("direction") > 0, 1.0).otherwise(-1.0), F.get("bars", F.lit(0))["o"], F.col("action")
    behind = F.when(act == number["limit_2tick"], 2 * pip).when(act == number["limit_3tick"], 3 * pip).when(act == number["limit_half_atr"], 0.5 * F.col("atr")).when(act == number["passive_limit_1tick"], pip)
    rows = rows.withColumns({"__pip": pip, "__side": side, "__first": first, "limit": first - side * behind})
    reach = lambda x, by: F.when(F.col("__side") > 0, x["l"] <= F.col("limit") + by).otherwise(x["h"] >= F.col("limit") - by)
    market = act == number["market_now"]
    rows = rows.withColumns({"__at": F.when(market & first.isNotNull(), F.lit(1).cast("bigint")).otherwise(F.array_position(F.transform("bars", lambda x: reach(x, -F.col("__pip"))), True)), "__near": F.exists("bars", lambda x: reach(x, F.col("__pip")))})
    slipped = F.col("__first") + F.col("__side") * F.greatest(atr_slip * F.greatest("atr", F.lit(1e-8)), pip_slip * F.col("__pip"))
    waits, none = act == number["reject_wait"], F.col("__first").isNull()
    filled = ~waits & ~none & F.coalesce(F.col("__at") > 0, F.lit(False))
    rows = rows.withColumn("filled", filled).withColumn("fill_price", F.when(F.col("filled"), F.when(market, slipped).otherwise(F.col("limit"))))
    rows = rows.withColumn("__rest", F.when(F.col("filled"), F.slice("bars", F.col("__at").cast("int"), bars_ahead)))
    gain = lambda x: (x - F.col("fill_price")) * F.col("__side")
    best = F.array_max(F.transform("__rest", lambda x: gain(F.when(F.col("__side") > 0, x["h"]).otherwise(x["l"]))))
    worst = F.array_max(F.transform("__rest", lambda x: -gain(F.when(F.col("__side") > 0, x["l"]).otherwise(x["h"]))))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    rows = rows.withColumns({"mfe": zero(best), "mae": zero(worst), "edge": zero(gain(F.col("__first"))), "slippage": zero(F.abs(F.col("fill_price") - F.col("__first"))), "__end": gain(F.element_at("__rest", -1)["c"])})
    reward = F.when(waits, WAIT_REWARD).when(none, 0.0).when(~F.col("filled"), UNFILLED_REWARD).otherwise(F.col("__end") + BEST_WEIGHT * F.greatest("mfe", F.lit(0.0)) - WORST_WEIGHT * F.greatest("mae", F.lit(0.0)))
    out = rows.withColumns({"reward": reward, "no_fill": ~waits & ~F.col("filled"), "near_miss": ~waits & ~none & ~F.col("filled") & F.coalesce("__near", F.lit(False)), "fill_dt": F.get("__rest", F.lit(0))["t"]})
    return out.select("event_id", F.get(F.array(*map(F.lit, ACTIONS)), act).alias("action"), "filled", "no_fill", "near_miss", "fill_dt", "fill_price", "reward", "edge", "slippage", "mfe", "mae")


def shared_currency(symbols: DataFrame) -> DataFrame:
    """(a, b), a < b, of six-letter symbols that share base or quote, by an equi-join on the currency."""
    legs = symbols.select("symbol", F.explode(F.array(F.substring("symbol", 1, 3), F.substring("symbol", 4, 3))).alias("cur"))
    a, b = legs.select(F.col("symbol").alias("a"), "cur"), legs.select(F.col("symbol").alias("b"), "cur")
    return a.join(b, "cur").where("a < b").select("a", "b").distinct()


def missing_anti(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, status): expected keys not found are missing, found ones not expected unexpected."""
    e, f = expected.select(key).distinct(), found.select(key).distinct()
    return e.join(f, key, "left_anti").withColumn("status", F.lit("missing")).unionByName(f.join(e, key, "left_anti").withColumn("status", F.lit("unexpected")))


def at_or_first(x: Column, order: Window) -> Column:
    return F.coalesce(x, F.first(x, ignorenulls=True).over(order))
