"""Queries of the model stage; fits have no SQL form, their inputs have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.ml.functions import array_to_vector

from barloom.operators import graph, labels, ml
from barloom.operators import indicators as ind
from barloom.operators.quantiles import kept
from barloom.plans.graph_queries import LAGGARD, true_returns
from barloom.plans.indicator_queries import ALL, CONTEXT, CONTEXT_COLUMNS, context
from barloom.plans.registry import SQL, hourly, query, quotes, scored, table

FEATURES = ["ret_1", "ret_3", "range_norm", "body_ratio", "tk"]


def _bars(spark: SparkSession, d: str) -> DataFrame:
    """The hourly bars, written once: fits read their rows many times."""
    return kept(hourly(spark, d))


def _rows(bars: DataFrame) -> DataFrame:
    b = labels.label_next_bar(ind.shape(ind.log_ret(ind.log_ret(bars, 1), 3)))
    return ml.pooled_rows(ml.class_weights(b.where("label is not null"), "label"), FEATURES, "label", "w")


@query("ml_pooled_rows", "symbol:s dt:t ret_1:d range_norm:d label:i", f"SELECT symbol, dt, ret AS ret_1, (h - l) / nullif(abs(c), 0) AS range_norm, CASE WHEN nx > c THEN 1 ELSE 0 END AS label FROM (SELECT *, lead(c) OVER {ALL} AS nx FROM rets) WHERE nx IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    x = vector_to_array("features")
    return _rows(_bars(spark, d)).select("symbol", "dt", x[0].alias("ret_1"), x[2].alias("range_norm"), "label")


@query("ml_class_weights", "label:i n:i w:d", f"WITH r AS (SELECT CASE WHEN nx > c THEN 1 ELSE 0 END AS label FROM (SELECT *, lead(c) OVER {ALL} AS nx FROM bars) WHERE nx IS NOT NULL) SELECT label, count(*) AS n, (SELECT count(*) FROM r) / (2.0 * count(*)) AS w FROM r GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rows(_bars(spark, d)).groupBy("label").agg(F.count("*").alias("n"), F.max("w").alias("w"))


@query("ml_binary_boosted", "symbol:s dt:t p:d")
def _(spark: SparkSession, d: str) -> DataFrame:
    train, test = ml.time_split(_rows(_bars(spark, d)))
    return ml.scored(ml.boosted(train, trees=10), test)


@query("ml_forest", "symbol:s dt:t p:d")
def _(spark: SparkSession, d: str) -> DataFrame:
    train, test = ml.time_split(_rows(_bars(spark, d)))
    return ml.scored(ml.forest(train, trees=10), test)


@query("ml_tree_suite", "model:s auc:d")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ml.tree_suite(*ml.time_split(_rows(_bars(spark, d))), FEATURES)[0]


@query("ml_importances", "feature:s mean_rank:d mean_importance:d rank:i")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ml.top_importances(ml.tree_suite(*ml.time_split(_rows(_bars(spark, d))), FEATURES)[1], 2, ["ret_1"])


@query("ml_walkforward", "fold:i part:s n:i auc:d brier:d brier_cal:d")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = _bars(spark, d)
    return ml.walkforward(_rows(b), labels.folds_walkforward(b))


@query("ml_platt", "coef:d intercept:d")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ml.platt(scored(spark, d), "p", "y")


@query("ml_isotonic", "id:i p:d p_cal:d")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ml.isotonic(scored(spark, d), "p", "y")


@query("ml_outlier_consensus", "id:i votes:i outlier:b")
def _(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return ml.outlier_consensus(v)


def _model(rows: str, p: str, entry: str) -> str:
    return f"SELECT symbol, dt, avg(({p} % 101) / 101.37::DOUBLE) AS p, avg(({entry} % 101) / 101.37::DOUBLE) AS entry FROM {rows} GROUP BY 1, 2"


LAG_COLUMNS = "nb_momentum momentum_residual nb_volatility vol_laggard laggard_score strength".split()
COARSE, FINE = _model("(SELECT symbol, date_trunc('day', ts) AS dt, id, k FROM quotes)", "k", "id * 53"), _model("(SELECT symbol, date_trunc('hour', ts) AS dt, id, k FROM quotes)", "id * 37", "k * 7")


@query(
    "meta_feature_rows", " ".join(["symbol:s dt:t p_coarse:d p_fine:d entry_coarse:d entry_fine:d conf_coarse:d conf_fine:d", *(f"{c}:d" for c in [*CONTEXT_COLUMNS, *LAG_COLUMNS]), "y:i"]),
    f"SELECT f.symbol, f.dt, m.p AS p_coarse, f.p AS p_fine, m.entry AS entry_coarse, f.entry AS entry_fine, 2 * abs(m.p - 0.5) AS conf_coarse, 2 * abs(f.p - 0.5) AS conf_fine, {', '.join(f'x.{c}' for c in CONTEXT_COLUMNS)}, {', '.join(f'coalesce(l.{c}, 0) AS {c}' for c in LAG_COLUMNS)}, n.label AS y FROM ({FINE}) f JOIN ({COARSE}) m ON m.symbol = f.symbol AND m.dt = date_trunc('day', f.dt) JOIN {CONTEXT} x ON x.symbol = f.symbol AND x.dt = f.dt LEFT JOIN {LAGGARD} l ON l.symbol = f.symbol AND l.dt = f.dt JOIN ({SQL['label_next_bar']}) n ON n.symbol = f.symbol AND n.dt = f.dt WHERE n.label IS NOT NULL",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Two scored tables, a day's and an hour's; the model that scored them is stood for by columns of the events."""
    q = quotes(spark, d)
    score = lambda unit, p, e: q.groupBy("symbol", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("dt")).agg(F.avg(p % 101 / 101.37).alias("p"), F.avg(e % 101 / 101.37).alias("entry"))
    coarse, fine = score("day", F.col("k"), F.col("id") * 53), score("hour", F.col("id") * 37, F.col("k") * 7)
    return ml.meta_rows(coarse, fine, "day", context(spark, d), graph.laggard_features(true_returns(spark, d)), labels.label_next_bar(hourly(spark, d)))
