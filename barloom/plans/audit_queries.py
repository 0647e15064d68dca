"""Queries of completeness and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import calendar
from barloom.operators import audit
from barloom.operators import indicators as ind
from barloom.plans.indicator_queries import ALL, over
from barloom.plans.registry import hourly, query, quotes, returns, table

COVER = "(SELECT g.period, g.symbol, coalesce(n, 0) AS n, first, last, coalesce(greatest(floor(date_diff('second', first, last) / 3600 * 5 / 7) + 1, 1), 0) AS expected FROM (SELECT * FROM (SELECT DISTINCT date_trunc('week', dt) AS period FROM bars), (SELECT DISTINCT symbol FROM bars UNION SELECT 'refund')) g LEFT JOIN (SELECT date_trunc('week', dt) AS period, symbol, count(*) AS n, min(dt) AS first, max(dt) AS last FROM bars GROUP BY 1, 2) h USING (period, symbol))"
STATUS = f"(SELECT *, coalesce(n * 100.0 / nullif(expected, 0), 0) AS pct, CASE WHEN n = 0 THEN 'missing' WHEN coalesce(n * 100.0 / nullif(expected, 0), 0) >= 98 THEN 'full' WHEN coalesce(n * 100.0 / nullif(expected, 0), 0) >= 80 THEN 'partial' ELSE 'sparse' END AS status FROM {COVER})"


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    b = hourly(spark, d)
    expected = b.select("symbol").distinct().unionByName(b.limit(1).select(F.lit("refund").alias("symbol")))
    return audit.audit_coverage(b, expected, F.date_trunc("week", F.col("dt")).cast("timestamp_ntz"), 3600)


@query("audit_coverage", "period:t symbol:s n:i expected:i pct:d status:s", f"SELECT * FROM {STATUS}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d)


@query("audit_year_rollup", "symbol:s period:t n_missing:i n:i", f"SELECT symbol, period, count(*) FILTER (status = 'missing') AS n_missing, count(*) AS n FROM {STATUS} GROUP BY GROUPING SETS ((symbol), (period))")
def _(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit_rollup(_coverage(spark, d))


@query("audit_gaps", "symbol:s max_gap_s:i gaps:i weekend_gaps:i odd_gaps:i", "SELECT symbol, max(g) AS max_gap_s, count(*) FILTER (g > 10800) AS gaps, count(*) FILTER (g > 10800 AND isodow(b) >= 5 AND g <= 201600) AS weekend_gaps, count(*) FILTER (g > 10800 AND NOT (isodow(b) >= 5 AND g <= 201600)) AS odd_gaps FROM (SELECT symbol, lag(dt) OVER w AS b, date_diff('second', lag(dt) OVER w, dt) AS g FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY dt)) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit_gaps(hourly(spark, d), 3600)


@query("audit_intraday_completeness", "symbol:s expected:d found:i missing:d", "WITH dd AS (SELECT symbol, CAST(dt AS DATE) AS day, count(*) AS n FROM bars GROUP BY 1, 2), c AS (SELECT s.symbol, CAST(unnest(generate_series(s.a, s.z, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT symbol, min(CAST(dt AS DATE)) AS a, max(CAST(dt AS DATE)) AS z FROM bars GROUP BY 1) s), j AS (SELECT c.symbol, c.day, isodow(c.day) AS wd, n FROM c LEFT JOIN dd ON dd.symbol = c.symbol AND dd.day = c.day), r AS (SELECT symbol, wd, CASE WHEN count(n) / count(*) >= 0.35 THEN round(quantile_cont(n, 0.9)) ELSE 0 END AS want FROM j GROUP BY 1, 2) SELECT j.symbol, sum(want) AS expected, sum(coalesce(n, 0)) AS found, sum(greatest(want - coalesce(n, 0), 0)) AS missing FROM j JOIN r ON j.symbol = r.symbol AND j.wd = r.wd GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit_intraday(hourly(spark, d))


@query("audit_spreads", "symbol:s min:d max:d mean:d median:d zeros:i negative:i", "SELECT symbol, min(spread) AS min, max(spread) AS max, avg(spread) AS mean, quantile_cont(spread, 0.5) AS median, count(*) FILTER (spread = 0) AS zeros, count(*) FILTER (spread < 0) AS negative FROM quotes GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit_spreads(quotes(spark, d))


@query("audit_flags", "symbol:s flags:i n:i rank:i", "SELECT * FROM (SELECT symbol, flags, count(*) AS n, row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, flags) AS rank FROM quotes GROUP BY 1, 2) WHERE rank <= 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    return audit.top_flags(quotes(spark, d))


@query("inspect_table", "symbol:s n:i first:t last:t", "SELECT symbol, count(*) AS n, min(dt) AS first, max(dt) AS last FROM bars GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return audit.inspect_table(hourly(spark, d))


@query("seasonal_profile_fill", "symbol:s dt:t sp:d", "WITH b AS (SELECT symbol, dt, CASE WHEN tk % 3 <> 0 THEN sp END AS sp, (isodow(dt) - 1) * 24 + hour(dt) AS k FROM bars), m AS (SELECT k, quantile_cont(sp, 0.5) AS m FROM b WHERE sp IS NOT NULL GROUP BY 1) SELECT symbol, dt, coalesce(sp, m, (SELECT quantile_cont(sp, 0.5) FROM b)) AS sp FROM b LEFT JOIN m USING (k)")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = hourly(spark, d).withColumn("sp", F.when(F.col("tk") % 3 != 0, F.col("sp")))
    return audit.seasonal_profile_fill(b, "sp", calendar.hour_of_week(F.col("dt")))


@query("dataset_coverage", "n:i valid_ratio:d positive_ratio:d non_finite:i", f"SELECT count(*) AS n, avg(CASE WHEN rn > 15 THEN 1.0 ELSE 0.0 END) AS valid_ratio, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS positive_ratio, count(*) FILTER (z IS NULL) AS non_finite FROM (SELECT *, row_number() OVER {ALL} AS rn, lag(c, 15) OVER {ALL} AS z FROM rets)")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = returns(spark, d).withColumns({"valid": F.row_number().over(ind.by_time()) > 15, "z": F.lag("c", 15).over(ind.by_time())})
    return audit.dataset_coverage(r, ["z", "ret"], "ret")


@query("matrix_diagnostics", "feature:s n:i non_finite:i variance:d constant:b", " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n, count(*) FILTER ({c} IS NULL) AS non_finite, var_pop({c}) AS variance, coalesce(var_pop({c}) < 1e-12, true) AS constant FROM rets" for c in ("c", "sp", "ret")))
def _(spark: SparkSession, d: str) -> DataFrame:
    return audit.matrix_diagnostics(returns(spark, d), ["c", "sp", "ret"])
