"""K-means labels for unlabelled history, and the choice of k."""

from __future__ import annotations

import sys
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions.columns import squared_distance
from tallyflow.operators.features import assemble
from tallyflow.operators.neighbors import usable
from tallyflow.schemas import CLUSTERS, FEATURES, KMEANS_SEED, SWEEP_KS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = 4096  # rows whose distances a task holds at once
START_ROWS = 10_000
FEW = 32  # tasks whose sums the driver adds up itself


def fit_kmeans(df: DataFrame, k: int = CLUSTERS, seed: int = KMEANS_SEED) -> KMeansModel:
    return KMeans(k=k, seed=seed, featuresCol="features").fit(assemble(df).select("features"))


def label(df: DataFrame, model: KMeansModel) -> DataFrame:
    """``df`` with the cluster of every row as ``prediction``."""
    labelled = model.transform(assemble(df)).drop("features")
    return labelled.withColumn("prediction", F.col("prediction").cast("bigint"))


def model_centers(df: DataFrame, model: KMeansModel) -> DataFrame:
    """Cluster centres, one row each."""
    rows = [(i, *map(float, c)) for i, c in enumerate(model.clusterCenters())]
    schema = "prediction bigint, " + ", ".join(f"{f} double" for f in FEATURES)
    return df.sparkSession.createDataFrame(rows, schema)


def cluster_means(df: DataFrame) -> DataFrame:
    """Mean of the features per label: one centre update."""
    return df.groupBy("prediction").agg(*[F.avg(f).alias(f) for f in FEATURES])


def assign(df: DataFrame, centers: list[tuple[int, list[float]]]) -> DataFrame:
    """Nearest of the given centres (few, so literals); the smaller label on ties."""
    options = [
        F.struct(squared_distance(FEATURES, c).alias("gap"), F.lit(name).cast("bigint").alias("label"))
        for name, c in centers
    ]
    return df.withColumn("prediction", F.array_min(F.array(*options))["label"])


def cluster_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("prediction").agg(F.count(F.lit(1)).alias("count"))


def silhouette(df: DataFrame) -> float:
    """Mean silhouette, squared Euclidean distance."""
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="prediction")
    return evaluator.evaluate(assemble(df).select("features", "prediction"))


# ---- many clusterings at a time ----

Centers = dict[int, np.ndarray]  # the centres of each k, one row each


def _sums_schema() -> str:
    return "k int, prediction long, n long, " + ", ".join(f"{f} double" for f in FEATURES) + ", squares double"


def _stacked(centers: Centers) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """All centres as one array, and where those of each k lie in it."""
    ends = np.cumsum([len(c) for c in centers.values()]).tolist()
    return np.concatenate(list(centers.values())), [(k, end - len(c), end) for (k, c), end in zip(centers.items(), ends)]


def _nearest(x: np.ndarray, every: np.ndarray, first: int, last: int) -> np.ndarray:
    """Nearest of some centres, the smaller number on ties; squared gaps are added in feature order, as in SQL."""
    gap = np.zeros((len(x), last - first))
    for j in range(x.shape[1]):
        away = x[:, j, None] - every[None, first:last, j]
        gap += away * away
    return gap.argmin(axis=1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES])


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows without those equal to the row before, and how many each stands for: the VLAN rows of a source are equal."""
    first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]).any(axis=1)))[: len(x)]
    return x[first], np.diff(np.append(first, len(x))).astype(float)


def cluster_moments(df: DataFrame, centers: Centers) -> DataFrame:
    """Rows, feature sums and sum of squared lengths per k and centre, in one pass for all k.

    A task sends one row per centre, so what is shuffled does not grow with the rows; from few tasks they
    are not shuffled, so there may be a row for each task. Rows with a missing or infinite feature are left out.
    """
    sent = df.sparkSession.sparkContext.broadcast(_stacked(centers))

    def add(batches):
        every, places = sent.value
        total = np.zeros((len(every), len(FEATURES) + 2))
        for batch in batches:
            for begin in range(0, len(batch), ROWS):
                x, many = _runs(_matrix(batch.slice(begin, ROWS)))
                held = np.column_stack([np.ones(len(x)), x, (x * x).sum(axis=1)]) * many[:, None]
                for _, first, last in places:
                    near = _nearest(x, every, first, last)
                    for j in range(held.shape[1]):
                        total[first:last, j] += np.bincount(near, held[:, j], minlength=last - first)
        columns = [np.concatenate([np.full(last - first, k, np.int32) for k, first, last in places])]
        columns += [np.concatenate([np.arange(last - first) for _, first, last in places]), total[:, 0].astype(np.int64)]
        columns += [total[:, j] for j in range(1, total.shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k", "prediction", "n", *FEATURES, "squares"])

    rows = df.filter(usable()).select(*[F.col(f).cast("double").alias(f) for f in FEATURES])
    parts = rows.mapInArrow(add, _sums_schema())
    if df.rdd.getNumPartitions() <= FEW:
        return parts
    return parts.groupBy("k", "prediction").agg(*[F.sum(c).alias(c) for c in ("n", *FEATURES, "squares")])


def _moments(df: DataFrame, centers: Centers) -> dict[int, np.ndarray]:
    """Collected moments, per k one row (n, sums, squares) for each centre: as many rows as there are centres."""
    out = {k: np.zeros((len(c), len(FEATURES) + 2)) for k, c in centers.items()}
    for r in cluster_moments(df, centers).collect():
        out[r["k"]][r["prediction"]] += [r["n"], *(r[f] for f in FEATURES), r["squares"]]
    return out


def lloyd_step(df: DataFrame, centers: Centers) -> Centers:
    """Every centre moved to the mean of its rows, for all k in one pass; a centre without rows stays."""
    moments = _moments(df, centers)
    return {k: np.where(m[:, :1] > 0, m[:, 1:-1] / np.maximum(m[:, :1], 1), centers[k]) for k, m in moments.items()}


def center_rows(spark: SparkSession, centers: Centers) -> DataFrame:
    rows = [(k, i, *map(float, c)) for k, held in centers.items() for i, c in enumerate(held)]
    return spark.createDataFrame(rows, "k int, prediction long, " + ", ".join(f"{f} double" for f in FEATURES))


def silhouettes(df: DataFrame, centers: Centers) -> DataFrame:
    """Mean silhouette (squared distance) of every k in two passes: cluster moments, then all rows against them.

    The mean squared distance of x to a cluster is |x|^2 + squares / n - 2 x . sums / n. A row alone
    in its cluster counts 0; with fewer than two clusters in use the silhouette is NULL.
    """
    moments = _moments(df, centers)
    every, places = _stacked(centers)
    sent = df.sparkSession.sparkContext.broadcast((every, places, np.concatenate(list(moments.values()))))

    def add(batches):
        every, places, held = sent.value
        totals, n = np.zeros(len(places)), 0
        for batch in batches:
            for begin in range(0, len(batch), ROWS):
                x, many = _runs(_matrix(batch.slice(begin, ROWS)))
                n += int(many.sum())
                length = (x * x).sum(axis=1)
                for i, (_, first, last) in enumerate(places):
                    m = held[first:last]
                    size = np.maximum(m[:, 0], 1)
                    away = np.maximum(length[:, None] + m[:, -1] / size - 2 * x @ (m[:, 1:-1] / size[:, None]).T, 0.0)
                    rows, near = np.arange(len(x)), _nearest(x, every, first, last)
                    own = m[near, 0]
                    inside = away[rows, near] * own / np.maximum(own - 1, 1)
                    away[rows, near] = np.inf
                    away[:, m[:, 0] == 0] = np.inf
                    outside = away.min(axis=1)
                    largest = np.maximum(inside, outside)
                    share = np.divide(outside - inside, largest, out=np.zeros(len(x)), where=largest > 0)
                    totals[i] += (share * many)[own > 1].sum() if np.isfinite(outside).all() else np.nan
        columns = [pa.array([k for k, _, _ in places], pa.int32()), pa.array(totals), pa.array(np.full(len(places), n))]
        yield pa.RecordBatch.from_arrays(columns, ["k", "total", "n"])

    rows = df.filter(usable()).select(*[F.col(f).cast("double").alias(f) for f in FEATURES])
    scores = rows.mapInArrow(add, "k int, total double, n long").groupBy("k")
    return scores.agg(F.nanvl(F.try_divide(F.sum("total"), F.sum("n")), F.lit(None)).alias("silhouette"))


def start_centers(df: DataFrame, ks: Iterable[int], seed: int, rows: int = START_ROWS) -> Centers:
    """Starting centres of all k, drawn from about ``rows`` sampled rows, far ones more likely.

    One draw serves all: k takes the first k centres. The sample only decides where the search starts.
    """
    usable_rows = df.filter(usable()).select(*FEATURES)
    share = min(1.0, rows / max(usable_rows.count(), 1))
    sample = (usable_rows if share == 1.0 else usable_rows.sample(share, seed=seed)).toArrow()
    x = np.column_stack([sample.column(f).to_numpy().astype(float) for f in FEATURES])
    rng, most = np.random.default_rng(seed), max(ks)
    if not len(x):
        raise ValueError("no rows to cluster")
    x = x[np.lexsort(x.T)]  # the order of the tasks does not matter
    chosen = [x[rng.integers(len(x))]]
    gap = ((x - chosen[0]) ** 2).sum(axis=1)
    tries = 2 + int(np.log(most))
    while len(chosen) < most:
        chance = gap / gap.sum() if gap.sum() > 0 else None
        drawn = rng.choice(len(x), tries, p=chance)
        options = [np.minimum(gap, ((x - x[i]) ** 2).sum(axis=1)) for i in drawn]
        best = int(np.argmin([o.sum() for o in options]))
        chosen.append(x[drawn[best]])
        gap = options[best]
    return {k: _settled(x, np.array(chosen[:k])) for k in ks}


def _settled(x: np.ndarray, centers: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Centres after some updates over the sample alone, so that fewer passes over all rows are left."""
    for _ in range(rounds):
        near = _nearest(x, centers, 0, len(centers))
        size = np.bincount(near, minlength=len(centers))[:, None]
        sums = np.column_stack([np.bincount(near, c, minlength=len(centers)) for c in x.T])
        centers = np.where(size > 0, sums / np.maximum(size, 1), centers)
    return centers


def fit_sweep(df: DataFrame, ks: Iterable[int], seed: int = KMEANS_SEED, max_iter: int = 20, tol: float = 1e-4) -> Centers:
    """Centres for every k. A pass over the rows moves the centres of all k that still move more than ``tol``."""
    centers = start_centers(df, list(ks), seed)
    moving = dict(centers)
    for _ in range(max_iter):
        if not moving:
            break
        moved = lloyd_step(df, moving)
        still = {k for k, c in moved.items() if ((c - moving[k]) ** 2).sum(axis=1).max() > tol * tol}
        centers |= moved
        moving = {k: moved[k] for k in still}
    return centers


def sweep_k(df: DataFrame, ks: Iterable[int] = SWEEP_KS, seed: int = KMEANS_SEED) -> DataFrame:
    """Silhouette for each k; every pass serves all of them."""
    points = df.select(*FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = [tuple(r) for r in silhouettes(points, fit_sweep(points, ks, seed)).select("k", "silhouette").collect()]
    finally:
        points.unpersist()
    return df.sparkSession.createDataFrame(sorted(rows), "k int, silhouette double")


def best_k(curve: DataFrame, score: str, largest: bool = True) -> DataFrame:
    """The best score and its k; the smallest k on ties."""
    order = -F.col("k")
    if largest:
        pick = F.max_by("k", F.struct(F.col(score), order))
        best = F.max(score)
    else:
        pick = F.min_by("k", F.struct(F.col(score), F.col("k")))
        best = F.min(score)
    return curve.agg(pick.alias("k"), best.alias(score))
