"""The model stage on Spark ML: assembled rows, boosted and forest classifiers, calibration, outliers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.quantiles import exact_quantiles, kept


def pooled_rows(rows: DataFrame, features: list[str], label: str, weight: str | None = None) -> DataFrame:
    """(symbol, dt, features vector, label, w): rows without nulls in what is used."""
    kept = rows.dropna(subset=[*features, label])
    out = VectorAssembler(inputCols=features, outputCol="features").transform(kept)
    return out.select("symbol", "dt", "features", F.col(label).cast("double").alias("label"), (F.col(weight) if weight else F.lit(1.0)).alias("w"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """rows with w: n / (classes * n of the row's class)."""
    per = rows.groupBy(label).agg(F.count("*").alias("__n"))
    total = per.agg(F.sum("__n").alias("__t"), F.count("*").alias("__k"))
    return rows.join(F.broadcast(per.join(total)), label).withColumn("w", F.col("__t") / (F.col("__k") * F.col("__n"))).drop("__n", "__t", "__k")


def boosted(train: DataFrame, seed: int = 7, trees: int = 20, depth: int = 3) -> PipelineModel:
    return Pipeline(stages=[GBTClassifier(maxIter=trees, maxDepth=depth, weightCol="w", seed=seed)]).fit(train)


def forest(train: DataFrame, seed: int = 7, trees: int = 20, depth: int = 4) -> PipelineModel:
    return Pipeline(stages=[RandomForestClassifier(numTrees=trees, maxDepth=depth, weightCol="w", seed=seed)]).fit(train)


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    p = vector_to_array("probability")
    return model.transform(rows).withColumn("p", p[1])


def _trees(seed: int) -> dict:
    return {"decision_tree": DecisionTreeClassifier(maxDepth=4, seed=seed), "forest": RandomForestClassifier(numTrees=20, maxDepth=4, seed=seed), "boosted": GBTClassifier(maxIter=10, maxDepth=3, seed=seed)}


def tree_suite(train: DataFrame, test: DataFrame, names: list[str], seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(model, auc) of three tree models on the later part of the data, and (model, feature, importance) of each feature."""
    judge, got, long = BinaryClassificationEvaluator(), [], []
    for name, m in _trees(seed).items():
        fitted = m.fit(train)
        got.append((name, float(judge.evaluate(fitted.transform(test)))))
        long += [(name, f, float(x)) for f, x in zip(names, fitted.featureImportances.toArray(), strict=True)]
    spark = train.sparkSession
    return spark.createDataFrame(got, "model string, auc double"), spark.createDataFrame(long, "model string, feature string, importance double")


def top_importances(importances: DataFrame, k: int, core: list[str]) -> DataFrame:
    """(feature, mean_rank, mean_importance, rank): the k features of the least mean rank over models, and those of `core` whatever their rank.

    A model ranks its features by importance, ties by name; importances: (model, feature, importance), a row a model and feature.
    """
    r = importances.withColumn("__r", F.row_number().over(Window.partitionBy("model").orderBy(F.col("importance").desc(), "feature")))
    m = r.groupBy("feature").agg(F.avg("__r").alias("mean_rank"), F.avg("importance").alias("mean_importance"))
    m = m.withColumn("rank", F.row_number().over(Window.orderBy("mean_rank", "feature")))  # a row a feature
    return m.where((F.col("rank") <= k) | F.col("feature").isin(core))


def platt(rows: DataFrame, p: str, label: str) -> DataFrame:
    """(coef, intercept) of a logistic fit on the logit of p."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    v = rows.select(array_to_vector(F.array(F.log(q / (1 - q)))).alias("features"), F.col(label).cast("double").alias("label"))
    m = LogisticRegression(maxIter=50).fit(v)
    return rows.sparkSession.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "coef double, intercept double")


def isotonic(rows: DataFrame, p: str, label: str) -> DataFrame:
    """rows with p_cal, p calibrated by a monotone fit."""
    r = rows.withColumn("label", F.col(label).cast("double"))
    return IsotonicRegression(featuresCol=p, labelCol="label", predictionCol="p_cal").fit(r).transform(r)


def walkforward(rows: DataFrame, folds: DataFrame, seed: int = 7) -> DataFrame:
    """(fold, part, n, auc, brier, brier_cal) of a boosted model a fold, on its validation part and its holdout; folds: (fold, symbol, dt, part).

    The isotonic calibration is fitted on the validation part, so brier_cal of
    that part is in sample and that of the holdout is not. Folds whose training
    or validation rows have one label only are left out; a part without rows has no row.
    """
    judge, got = BinaryClassificationEvaluator(), []
    rows, folds = kept(rows), kept(folds, "fold")  # a fold reads its own rows
    for fold in [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]:  # one row a fold
        part = rows.join(folds.where(F.col("fold") == fold), ["symbol", "dt"]).persist()
        of = {k: part.where(F.col("part") == k) for k in ("train", "valid", "holdout")}
        if all(of[k].select("label").distinct().count() > 1 for k in ("train", "valid")):
            model = boosted(of["train"], seed, 10)
            monotone = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="p_cal").fit(scored(model, of["valid"]))
            for k in ("valid", "holdout"):
                out = monotone.transform(scored(model, of[k])).persist()
                s = out.agg(F.count("*").alias("n"), F.count_distinct("label").alias("both"), *(F.avg(F.pow(F.col(c) - F.col("label"), 2)).alias(c) for c in ("p", "p_cal"))).first()
                if s["n"]:
                    got.append((int(fold), k, s["n"], float(judge.evaluate(out)) if s["both"] > 1 else None, s["p"], s["p_cal"]))
                out.unpersist()
        part.unpersist()
    return rows.sparkSession.createDataFrame(got, "fold int, part string, n bigint, auc double, brier double, brier_cal double")


#: Rows that a row is compared with at each side in a sorted table, tables, projections of a key and rows of a partition.
NEAR, TABLES, KEYS, PART_ROWS = 128, 8, 3, 20_000


def neighbour_distances(points: DataFrame, k: int = 5, seed: int = 7, tables: int = TABLES) -> DataFrame:
    """(id, distance): how far the k-th nearest other row is, from (id, x array<double>); null with fewer than k others.

    Locality-sensitive sorting: a table orders the rows by a few quantised
    random projections, so near rows mostly lie near each other in it; a row
    meets the NEAR rows before and after it in its partition, whatever a
    bucket's size. Each table gives a row its k best, tables are merged by id.
    """
    n, width = points.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        return points.select("id", F.lit(None).cast("double").alias("distance"))
    rng, parts = np.random.default_rng(seed), -(-n // PART_ROWS)
    kind, found = points.schema["id"].dataType.simpleString(), None
    spread = points.agg(*(F.stddev_pop(F.col("x")[i]).alias(str(i)) for i in range(width))).first()
    scale = float(np.sqrt(sum((v or 0.0) ** 2 for v in spread))) or 1.0

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))  # one partition's rows
        if not t.num_rows:
            return
        ids, x = t.column("id").combine_chunks(), np.array(t.column("x").to_pylist(), float)
        for a in range(0, len(x), NEAR):
            lo, hi = max(0, a - NEAR), min(len(x), a + 2 * NEAR)
            d = ((x[a : a + NEAR, None, :] - x[None, lo:hi, :]) ** 2).sum(axis=2)
            d[np.arange(len(d)), np.arange(len(d)) + a - lo] = np.inf  # not itself
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            mine = np.repeat(np.arange(a, a + len(d)), best.shape[1])
            dist = np.sqrt(np.take_along_axis(d, best, axis=1)).ravel()
            real = np.isfinite(dist)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(mine[real])), ids.take(pa.array((best + lo).ravel()[real])), pa.array(dist[real])], names=["id", "other", "d"])

    for _ in range(tables):
        keys = [F.floor(sum((F.col("x")[i] * float(v) for i, v in enumerate(rng.standard_normal(width))), F.lit(0.0)) / (scale * 0.25) + float(rng.random())) for _ in range(KEYS - 1)]
        keys.append(sum((F.col("x")[i] * float(v) for i, v in enumerate(rng.standard_normal(width))), F.lit(0.0)))
        keyed = points.select("id", "x", *(c.alias(f"__k{i}") for i, c in enumerate(keys)))
        names = [f"__k{i}" for i in range(KEYS)]
        one = keyed.repartitionByRange(parts, *names).sortWithinPartitions(*names).select("id", "x").mapInArrow(nearest, f"id {kind}, other {kind}, d double")
        found = one if found is None else found.unionAll(one)
    pairs = found.groupBy("id", "other").agg(F.min("d").alias("d"))
    return pairs.groupBy("id").agg(F.array_sort(F.collect_list("d")).alias("ds")).select("id", F.get("ds", F.lit(k - 1)).alias("distance"))  # at most tables * k a row


def outlier_consensus(vectors: DataFrame, k: int = 8, share: float = 0.02, neighbours: int = 5) -> DataFrame:
    """(id, votes, outlier) from (id, features): two votes of three make an outlier.

    After scaling and PCA: the squared norm in whitened components, the
    greatest robust z of the scaled features (by median and median absolute
    deviation), and the distance to the neighbours-th nearest row in the
    components; each votes for the `share` of rows where it is greatest.
    """
    scaled = StandardScaler(withMean=True, inputCol="features", outputCol="s").fit(vectors).transform(vectors)
    pca = PCA(k=k, inputCol="s", outputCol="pc").fit(scaled).transform(scaled)
    arr = pca.select("id", vector_to_array("pc").alias("x"), vector_to_array("s").alias("z"))
    stats = arr.agg(*(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(k)))
    sq = sum((F.pow(F.col("x")[i] / (F.col(f"s{i}") + 1e-12), 2) for i in range(k)), F.lit(0.0))
    cells = arr.select("id", F.posexplode("z").alias("f", "v"))
    middle = exact_quantiles(cells, ["f"], "v", [0.5]).withColumnRenamed("q0", "__m")
    off = cells.join(F.broadcast(middle), "f").withColumn("__d", F.abs(F.col("v") - F.col("__m")))  # a row a feature
    mad = exact_quantiles(off, ["f"], "__d", [0.5]).withColumnRenamed("q0", "__mad")
    robust = off.join(F.broadcast(mad), "f").groupBy("id").agg(F.max(0.6745 * F.col("__d") / F.greatest("__mad", F.lit(1e-12))).alias("b"))
    m = arr.join(F.broadcast(stats)).select("id", sq.alias("a")).join(robust, "id").join(neighbour_distances(arr.select("id", "x"), neighbours).withColumnRenamed("distance", "c"), "id", "left")
    cuts = [exact_quantiles(m, [], c, [1 - share]).withColumnRenamed("q0", f"q{c}") for c in "abc"]
    for c in cuts:
        m = m.join(F.broadcast(c), how="left")
    votes = sum((F.coalesce(F.col(c) > F.col(f"q{c}"), F.lit(False)).cast("int") for c in "abc"), F.lit(0))
    return m.select("id", votes.alias("votes"), (votes >= 2).alias("outlier"))


def time_split(rows: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Rows before and from the time that `share` of the distinct times precede."""
    t = rows.select("dt").distinct()
    cut = t.withColumn("q", F.percent_rank().over(Window.orderBy("dt"))).where(F.col("q") >= share).agg(F.min("dt").alias("cut"))
    j = rows.join(F.broadcast(cut))
    return j.where("dt < cut").drop("cut"), j.where("dt >= cut").drop("cut")


def meta_rows(coarse: DataFrame, fine: DataFrame, unit: str, context: DataFrame, laggards: DataFrame, labelled: DataFrame) -> DataFrame:
    """Rows of a second-stage model: each fine score (symbol, dt, p, entry) with the coarse one of its unit of time, confidences, context, neighbours' features (0 without) and label y."""
    c = coarse.select("symbol", F.col("dt").alias("__unit"), F.col("p").alias("p_coarse"), F.col("entry").alias("entry_coarse"))
    f = fine.select("symbol", "dt", F.date_trunc(unit, "dt").cast("timestamp_ntz").alias("__unit"), F.col("p").alias("p_fine"), F.col("entry").alias("entry_fine"))
    y = labelled.where("label is not null").select("symbol", "dt", F.col("label").alias("y"))
    rows = f.join(c, ["symbol", "__unit"]).join(context.drop("label"), ["symbol", "dt"]).join(y, ["symbol", "dt"]).join(laggards, ["symbol", "dt"], "left")
    near = {n: F.coalesce(n, F.lit(0.0)) for n in laggards.columns if n not in ("symbol", "dt")}
    return rows.withColumns({"conf_coarse": 2 * F.abs(F.col("p_coarse") - 0.5), "conf_fine": 2 * F.abs(F.col("p_fine") - 0.5), **near}).drop("__unit")
