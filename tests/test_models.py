"""Neighbour distances and outliers, importances, calibrated folds, late rows, open positions."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from barloom.operators import ml, signals


def _points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, x array<double>").repartition(3)


def test_neighbour_recall(spark, monkeypatch):
    """Of 4,000 points in clusters the fifth neighbour is found for nine in ten, though a row meets few others a table."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 4, (60, 8))[rng.integers(0, 60, 4000)] + rng.normal(0, 0.3, (4000, 8))
    monkeypatch.setattr(ml, "PART_ROWS", 1000)
    got = {r["id"]: r["distance"] for r in ml.neighbour_distances(_points(spark, x), 5).collect()}
    d = ((x[:, None, :] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    want = np.sqrt(np.sort(d, axis=1)[:, 4])
    near = np.array([got[i] for i in range(4000)])
    assert (near >= want - 1e-9).all() and (near <= want * 1.05).mean() >= 0.9


def test_neighbours_of_few_and_equal_points(spark):
    got = {r["id"]: r["distance"] for r in ml.neighbour_distances(_points(spark, [[0.0], [0.0], [3.0]]), 2).collect()}
    assert got == {0: 3.0, 1: 3.0, 2: 3.0}
    assert [r["distance"] for r in ml.neighbour_distances(_points(spark, [[1.0], [2.0]]), 2).collect()] == [None, None]
    assert ml.neighbour_distances(_points(spark, [[1.0]]).limit(0), 2).collect() == []


def test_planted_outliers_get_two_votes(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (400, 6))
    x[:5] += 12 * np.sign(rng.normal(0, 1, (5, 6)))
    v = _points(spark, x).select("id", array_to_vector("x").alias("features"))
    votes = {r["id"]: r["votes"] for r in ml.outlier_consensus(v, k=4, share=0.02).collect()}
    assert len(votes) == 400 and all(votes[i] >= 2 for i in range(5)) and sum(n >= 2 for n in votes.values()) <= 10


def test_importances_find_the_planted_feature(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (600, 3))
    rows = spark.createDataFrame([([float(v) for v in r], float(r[1] > 0)) for r in x], "x array<double>, label double").select(array_to_vector("x").alias("features"), "label", F.lit(1.0).alias("w"))
    auc, long = ml.tree_suite(rows, rows, ["a", "b", "c"])
    assert {r["model"]: r["auc"] > 0.95 for r in auc.collect()} == dict.fromkeys(("decision_tree", "forest", "boosted"), True)
    top = ml.top_importances(long, 1, ["c"]).orderBy("rank").collect()
    assert (top[0]["feature"], top[0]["mean_rank"], top[0]["rank"]) == ("b", 1.0, 1) and {r["feature"] for r in top} == {"b", "c"}


def test_open_positions_use_up_the_cap(spark):
    rows = spark.createDataFrame([(1, "EURUSD", 5.0), (1, "AUDNZD", 4.0), (2, "EURUSD", 5.0)], "dt int, symbol string, score double")
    opened = spark.createDataFrame([(1, "GBPUSD")], "dt int, symbol string")
    assert {(r["dt"], r["symbol"]) for r in signals.exposure_cap(rows, "score", 1, opened).collect()} == {(1, "AUDNZD"), (2, "EURUSD")}


def test_ranks_of_a_feature_need_no_model(spark):
    long = spark.createDataFrame([("m", "a", 0.5), ("m", "b", 0.5), ("n", "a", 0.1), ("n", "b", 0.9)], "model string, feature string, importance double")
    got = {r["feature"]: (r["mean_rank"], r["rank"]) for r in ml.top_importances(long, 2, []).collect()}
    assert got == {"a": (1.5, 1), "b": (1.5, 2)} and ml.top_importances(long, 0, []).collect() == []
    assert got["a"][0] == pytest.approx(1.5)


def test_walkforward_makes_its_rows_once(spark):
    """Two folds and their calibrations read rows that were written, they do not make them again."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    plain = spark.range(80).select(F.lit("A").alias("symbol"), F.timestamp_seconds("id").alias("dt"), (F.col("id") % 2).cast("double").alias("label"), ((F.col("id") * 7) % 11).cast("double").alias("x"))
    rows = plain.mapInPandas(counted, plain.schema).select("symbol", "dt", "label", array_to_vector(F.array("x")).alias("features"), F.lit(1.0).alias("w"))
    second = F.unix_seconds("dt")
    folds = [plain.select(F.lit(k).alias("fold"), "symbol", "dt", F.when(second < end, "train").when(second < end + 20, "valid").when(second >= 70, "holdout").alias("part")).where("part is not null") for k, end in enumerate((30, 50))]
    got = {(r["fold"], r["part"]): r["n"] for r in ml.walkforward(rows, folds[0].unionByName(folds[1])).collect()}
    assert got == {(0, "valid"): 20, (0, "holdout"): 10, (1, "valid"): 20, (1, "holdout"): 10}
    assert made.value == 80
