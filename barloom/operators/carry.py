"""Carries and numbers along a symbol's rows without its whole history in one task.

Rows are windowed in buckets of time, and what passes from bucket to bucket is
worked out on one short row a bucket: the long rows are shuffled once, by symbol
and bucket, and the joins back follow that partitioning.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket.
DAY = 86_400


def _bucketed(rows: DataFrame, time: str, seconds: int) -> DataFrame:
    return rows.withColumn("__bucket", F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds))


def _line() -> Window:
    return Window.partitionBy("symbol").orderBy("__bucket")


def carry(rows: DataFrame, order: list[Column], past: dict[str, Column] | None = None, ahead: dict[str, Column] | None = None, time: str = "dt", seconds: int = DAY) -> DataFrame:
    """rows with the last known value at or before each row (past) and the next at or after it (ahead), by name; null where there is none.

    order: ascending sort columns within a symbol, beginning with `time`. A name
    that rows already has is replaced. Rows without a time come first; rows
    without a symbol meet only those of their bucket.
    """
    past, ahead = past or {}, ahead or {}
    keyed = _bucketed(rows, time, seconds)
    inside, line, at = Window.partitionBy("symbol", "__bucket").orderBy(*order), _line(), F.struct(*order)
    known = lambda v: F.when(v.isNotNull(), at)
    ends = keyed.groupBy("symbol", "__bucket").agg(
        *(F.max_by(v, known(v)).alias(f"__past_{n}") for n, v in past.items()), *(F.min_by(v, known(v)).alias(f"__ahead_{n}") for n, v in ahead.items())
    )
    between = ends.select(
        "symbol", "__bucket",
        *(F.last(f"__past_{n}", True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias(f"__past_{n}") for n in past),
        *(F.first(f"__ahead_{n}", True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias(f"__ahead_{n}") for n in ahead),
    )
    held = keyed.withColumns(
        {f"__p_{n}": F.last(v, True).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for n, v in past.items()}
        | {f"__a_{n}": F.first(v, True).over(inside.rowsBetween(0, Window.unboundedFollowing)) for n, v in ahead.items()}
    )
    made = {n: F.coalesce(f"__p_{n}", f"__past_{n}") for n in past} | {n: F.coalesce(f"__a_{n}", f"__ahead_{n}") for n in ahead}
    kept = [made[c].alias(c) if c in made else F.col(c) for c in rows.columns]
    return held.join(between, ["symbol", "__bucket"], "left").select(*kept, *(x.alias(n) for n, x in made.items() if n not in rows.columns))


def numbered(rows: DataFrame, name: str, order: list[Column], time: str = "dt", seconds: int = DAY) -> DataFrame:
    """rows with their number (from 1) in the symbol's order as column `name`; order as in carry."""
    keyed = _bucketed(rows, time, seconds)
    counts = keyed.groupBy("symbol", "__bucket").agg(F.count("*").alias("__n"))
    before = counts.select("symbol", "__bucket", F.sum("__n").over(_line().rowsBetween(Window.unboundedPreceding, -1)).alias("__earlier"))
    here = F.row_number().over(Window.partitionBy("symbol", "__bucket").orderBy(*order))
    got = keyed.withColumn("__here", here).join(before, ["symbol", "__bucket"], "left")
    return got.select(*rows.columns, (F.col("__here") + F.coalesce("__earlier", F.lit(0))).alias(name))


#: Least rows of a block of positions.
BLOCK = 4_096


def _placed(rows: DataFrame, time: str, size: int) -> DataFrame:
    """rows with __no, their number in the symbol from 1, and __block, that number's block."""
    given = rows if "__no" in rows.columns else numbered(rows, "__no", [F.col(time)], time)
    return given.withColumn("__block", F.floor((F.col("__no") - 1) / size))


def numbered_first(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Numbers a function's rows by (symbol, dt) once, in column __no, for all the scans and windows over blocks that it chains."""

    @wraps(f)
    def run(rows: DataFrame, *args: object, **named: object) -> DataFrame:
        if "__no" in rows.columns:
            return f(rows, *args, **named)
        return f(numbered(rows, "__no", [F.col("dt")]), *args, **named).drop("__no")

    return run


def in_blocks(rows: DataFrame, lookback: int, f: Callable[[DataFrame], DataFrame], time: str = "dt", size: int | None = None) -> DataFrame:
    """f(rows), for an f that adds columns from a row and at most `lookback` rows of its symbol before it.

    Rows are dealt by symbol and block of positions instead of by symbol; a
    block also gets the last `lookback` rows of the one before, so that f sees
    what it would see in the whole series: its windows by symbol are windows by
    block, row numbers up to lookback + 1 included. f may use column __no, a
    row's number in its symbol. A block has at least eight times the rows that
    are copied.
    """
    size = size or max(BLOCK, 8 * lookback)
    if lookback > size:
        raise ValueError("a block is shorter than what is looked back on")
    placed = _placed(rows, time, size)
    last = (F.col("__no") - 1) % size >= size - lookback
    copies = placed.withColumn("__for", F.explode(F.when(last, F.array("__block", F.col("__block") + 1)).otherwise(F.array("__block"))))
    out = f(copies.withColumn("symbol", F.struct(F.col("symbol").alias("name"), F.col("__for").alias("block"))))
    own = out.where(F.col("__block") == F.col("symbol.block"))
    return own.withColumn("symbol", F.col("symbol.name")).drop("__block", "__for", *(() if "__no" in rows.columns else ("__no",)))


def running(rows: DataFrame, sums: dict[str, Column] | None = None, tops: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, time: str = "dt", size: int = BLOCK) -> DataFrame:
    """rows with running sums, maxima and last known values from a symbol's first row to each row, by name.

    A scan: each block's summary is one short row, summaries are put together
    along the symbol, and a row adds what its block holds up to it. Values may
    use __no, a row's number in its symbol, and __before(column).
    """
    sums, tops, lasts = sums or {}, tops or {}, lasts or {}
    placed = _placed(rows, time, size)
    inside = Window.partitionBy("symbol", "__block").orderBy("__no")
    line = Window.partitionBy("symbol").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy("symbol", "__block").agg(
        *(F.sum(v).alias(f"__of_{n}") for n, v in sums.items()), *(F.max(v).alias(f"__of_{n}") for n, v in tops.items()), *(F.max_by(v, F.when(v.isNotNull(), F.col("__no"))).alias(f"__of_{n}") for n, v in lasts.items())
    )
    between = ends.select(
        "symbol", "__block",
        *(F.sum(f"__of_{n}").over(line).alias(f"__until_{n}") for n in sums), *(F.max(f"__of_{n}").over(line).alias(f"__until_{n}") for n in tops), *(F.last(f"__of_{n}", True).over(line).alias(f"__until_{n}") for n in lasts),
    )
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    held = placed.withColumns({f"__in_{n}": F.sum(v).over(upto) for n, v in sums.items()} | {f"__in_{n}": F.max(v).over(upto) for n, v in tops.items()} | {f"__in_{n}": F.last(v, True).over(upto) for n, v in lasts.items()})
    at = lambda n: (F.col(f"__in_{n}"), F.col(f"__until_{n}"))
    made = {n: F.when(at(n)[0].isNull(), at(n)[1]).otherwise(at(n)[0] + F.coalesce(at(n)[1], F.lit(0))) for n in sums}
    made |= {n: F.greatest(*at(n)) for n in tops} | {n: F.coalesce(*at(n)) for n in lasts}
    return held.join(between, ["symbol", "__block"], "left").select(*rows.columns, *(c.alias(n) for n, c in made.items()))


def composed(rows: DataFrame, step: Column, then: Callable[[Column, Column], Column], same: Column, after: Callable[[Column, Column], Column], constant: Callable[[Column], Column], start: Column, name: str, time: str = "dt", size: int = 1_024) -> DataFrame:
    """rows with the state (column `name`) that a symbol's maps `step` lead to from `start`.

    then(first, second) is the map of two maps in turn, same the map that
    changes nothing, after(map, state) the state that a map leads to, constant
    tells a map that leads all states to one. Inside a block maps are put
    together by doubling: after k rounds a row holds the map of its block's last
    2^k rows, so a hold takes as many rounds whatever its length. A block's
    whole map is one short row; states at the blocks' starts follow from the
    block maps that change anything since the last constant one.
    """
    placed = _placed(rows, time, size).withColumn("__map", step)
    inside = Window.partitionBy("symbol", "__block").orderBy("__no")
    reach = 1
    while reach < size:
        placed = placed.withColumn("__map", then(F.coalesce(F.lag("__map", reach).over(inside), same), F.col("__map")))
        reach *= 2
    line, m = Window.partitionBy("symbol").orderBy("__block"), F.col("__all")
    ends = placed.groupBy("symbol", "__block").agg(F.max_by("__map", "__no").alias("__all"))
    idle = (m == same) | ((m == F.lag("__all").over(line)) & (then(m, m) == m))  # to no effect
    ends = ends.withColumns({"__step": F.when(~F.coalesce(idle, F.lit(False)) | constant(m), m), "__cut": F.sum(constant(m).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0))})
    since = F.collect_list("__step").over(Window.partitionBy("symbol", "__cut").orderBy("__block").rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("__state", F.aggregate(since, start, lambda s, x: after(x, s)))
    states = ends.select("symbol", "__block", F.lag("__state").over(line).alias("__at"))
    return placed.join(states, ["symbol", "__block"], "left").select(*rows.columns, after(F.col("__map"), F.coalesce("__at", start)).alias(name))
