"""Six classifiers compared by k-fold accuracy.

Every function returns ``(model, fold, accuracy)``, one row per fold, for a frame
with features, ``prediction`` as the true class, and ``fold``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.operators import machines
from tallyflow.operators.features import assemble
from tallyflow.operators.neighbors import NeighborModel
from tallyflow.operators.tuning import shuffled_folds
from tallyflow.operators.voting import knn_predict
from tallyflow.schemas import COMPARE_FOLDS, COMPARE_SEED, FEATURES

PARALLEL = 8  # fits at a time


def _fold_accuracy(name: str, predicted: DataFrame, guess: Column) -> DataFrame:
    right = (guess == F.col("prediction")).cast("double")
    scores = predicted.groupBy("fold").agg(F.avg(right).alias("accuracy"))
    return scores.select(F.lit(name).alias("model"), F.col("fold").cast("bigint").alias("fold"), "accuracy")


def _fold_sizes(points: DataFrame) -> dict[int, int]:
    return {r["fold"]: r["count"] for r in points.groupBy("fold").count().collect()}


def _by_fold(name: str, points: DataFrame, estimator: Callable[[int], object]) -> DataFrame:
    """Fit an ML estimator per fold on the other folds; score the fold it left out.

    ``estimator`` gets the number of training rows.
    """
    points = points.select("fold", "features", "prediction").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = _fold_sizes(points)
        rows = sum(sizes.values())

        def score(fold: int) -> list[tuple]:
            train = points.filter(F.col("fold") != fold)
            test = points.filter(F.col("fold") == fold)
            model = estimator(rows - sizes[fold]).fit(train)
            return [tuple(r) for r in _fold_accuracy(name, model.transform(test), F.col("guess")).collect()]

        with ThreadPool(PARALLEL) as pool:
            scores = sum(pool.map(score, sorted(sizes), chunksize=1), [])
    finally:
        points.unpersist()
    return points.sparkSession.createDataFrame(scores, "model string, fold bigint, accuracy double")


_COLUMNS = {"labelCol": "prediction", "predictionCol": "guess", "rawPredictionCol": "raw"}


def logistic_regression(df: DataFrame, max_iter: int = 100) -> DataFrame:
    """Multinomial, with an L2 penalty worth one row of loss."""

    def estimator(rows: int):
        return LogisticRegression(
            **_COLUMNS, probabilityCol="share", family="multinomial", maxIter=max_iter,
            regParam=1.0 / rows, elasticNetParam=0.0, standardization=False,
        )

    return _by_fold("LR", assemble(df), estimator)


def decision_tree(df: DataFrame, max_depth: int = 30, max_bins: int = 128) -> DataFrame:
    """Gini tree, grown as deep as the library allows; splits lie at the edges of ``max_bins`` quantile bins."""

    def estimator(rows: int):
        return DecisionTreeClassifier(
            **_COLUMNS, probabilityCol="share", impurity="gini", maxDepth=max_depth, maxBins=max_bins, seed=0
        )

    return _by_fold("CART", assemble(df), estimator)


def naive_bayes(df: DataFrame) -> DataFrame:
    def estimator(rows: int):
        return NaiveBayes(**_COLUMNS, probabilityCol="share", modelType="gaussian")

    return _by_fold("NB", assemble(df), estimator)


def kernel_features(df: DataFrame, count: int = 100, seed: int = 0) -> DataFrame:
    """``df`` with random cosine features, whose inner product approximates the RBF kernel, as the vector ``features``."""
    waves = machines.fit_waves(df, count, seed)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def values(*columns: pa.Array) -> pa.Array:
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])
        offsets = pa.array(np.arange(len(x) + 1) * count, pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(waves(x)[:, :count].ravel()))

    rest = [c for c in df.columns if c not in FEATURES]
    return df.select(*rest, array_to_vector(values(*FEATURES)).alias("features"))


def support_vectors(df: DataFrame, max_iter: int = 100, tol: float = 1e-6, kernel_count: int = 100) -> DataFrame:
    """One-against-rest machines on approximate RBF kernel features, all folds and classes fitted together."""
    return _fold_accuracy("SVM", machines.cross_validated(df, kernel_count, max_iter, tol), F.col("guess"))


def nearest_neighbors(df: DataFrame, k: int = 5, weights: str = "uniform") -> DataFrame:
    """All folds from one neighbour pass: neighbours come from the other folds."""
    model = NeighborModel.fit(df, k=k, apart="fold")
    predicted = knn_predict(df.withColumn("truth", F.col("prediction")).drop("prediction"), model, k, weights, "fold")
    predicted = predicted.select("fold", F.col("truth").alias("label"), F.col("Prediction").alias("guess"))
    right = (F.col("guess") == F.col("label")).cast("double")
    scores = predicted.groupBy("fold").agg(F.avg(right).alias("accuracy"))
    return scores.select(F.lit("KNN").alias("model"), F.col("fold").cast("bigint").alias("fold"), "accuracy")


def linear_discriminant(df: DataFrame) -> DataFrame:
    """Linear discriminant analysis with the pooled within-class covariance.

    One aggregation yields means and co-moments per fold and class, centred as they
    are summed; those of a training set are merged from its folds. Only 5 x 5 systems
    are solved on the driver; scoring joins the few coefficients of the fold.
    """
    names = FEATURES
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    moments = df.groupBy("fold", "prediction").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f).alias(f"m{i}") for i, f in enumerate(names)],
        *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).collect()  # folds x classes rows
    table = []
    for fold in sorted({m["fold"] for m in moments}):
        for label, constant, slope in _discriminant([m for m in moments if m["fold"] != fold], pairs):
            table.append((fold, label, constant, slope))
    spark = df.sparkSession
    lines = spark.createDataFrame(table, "fold bigint, label bigint, constant double, slope array<double>")
    lines = lines.groupBy("fold").agg(F.collect_list(F.struct("label", "constant", "slope")).alias("lines"))
    x = F.array(*[F.col(f).cast("double") for f in names])
    score = lambda line: line["constant"] + F.aggregate(
        F.zip_with(x, line["slope"], lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v
    )
    scored = F.transform("lines", lambda line: F.struct(score(line).alias("score"), (-line["label"]).alias("label")))
    joined = df.withColumn("fold", F.col("fold").cast("bigint")).join(F.broadcast(lines), "fold", "left")  # a row per fold
    return _fold_accuracy("LDA", joined.withColumn("guess", -F.array_max(scored)["label"]), F.col("guess"))


def _discriminant(moments: list, pairs: list[tuple[int, int]]) -> list[tuple[int, float, list[float]]]:
    """Label, constant and slope of each class's linear score, from the moments of the training rows."""
    width = len(FEATURES)
    classes: dict[int, list] = {}
    for m in moments:
        mean = np.array([m[f"m{i}"] for i in range(width)])
        spread = np.zeros((width, width))
        for i, j in pairs:
            spread[i, j] = spread[j, i] = m[f"c{i}_{j}"] * m["n"]
        held = classes.setdefault(m["prediction"], [0, np.zeros(width), np.zeros((width, width))])
        n, gap = held[0] + m["n"], mean - held[1]
        held[2] = held[2] + spread + np.outer(gap, gap) * (held[0] * m["n"] / n)
        held[1] = held[1] + gap * (m["n"] / n)
        held[0] = n
    total = sum(n for n, _, _ in classes.values())
    scatter = sum(spread for _, _, spread in classes.values())
    inverse = np.linalg.pinv(scatter / max(total - len(classes), 1))
    lines = []
    for label in sorted(classes):
        n, mean, _ = classes[label]
        slope = inverse @ mean
        lines.append((label, float(math.log(n / total) - 0.5 * mean @ slope), slope.tolist()))
    return lines


CLASSIFIERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "LR": logistic_regression,
    "LDA": linear_discriminant,
    "KNN": nearest_neighbors,
    "CART": decision_tree,
    "NB": naive_bayes,
    "SVM": support_vectors,
}


def compare_classifiers(
    df: DataFrame,
    models: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
    folds: int = COMPARE_FOLDS,
    seed: int = COMPARE_SEED,
) -> DataFrame:
    """Fold accuracies of every model over the same shuffled folds."""
    split = shuffled_folds(df, folds, seed)
    results = [run(split) for run in (models or CLASSIFIERS).values()]
    return reduce(DataFrame.unionByName, results)
