"""Gini trees of all folds, grown together level by level and kept as a table of nodes.

A level is one pass: every task walks its rows down the trees so far and counts classes by tree, node,
feature and bin; the counts are added up in Spark, and each node's best split is found from its own
counts. Rows never move. Splits lie at given edges of the features, and are exact there: of equal
ones the first feature and the lowest edge are taken. A row goes left if its value is below the threshold. Nodes are numbered as in a
heap (children of n: 2n + 1 and 2n + 2).
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.operators.neighbors import usable
from tallyflow.schemas import FEATURES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODES = "tree long, node long, feature int, threshold double, n long, prediction long"
BINS = 32


def even_edges(df: DataFrame, bins: int = BINS) -> dict[str, list[float]]:
    """Edges that cut each feature's range into equal parts."""
    stats = df.agg(*[F.min(f).alias(f"a_{f}") for f in FEATURES], *[F.max(f).alias(f"b_{f}") for f in FEATURES]).first()
    low, high = ([float(stats[f"{x}_{f}"]) for f in FEATURES] for x in "ab")
    return {f: [a + (b - a) * j / bins for j in range(1, bins)] for f, a, b in zip(FEATURES, low, high)}


def quantile_edges(df: DataFrame, bins: int = BINS) -> dict[str, list[float]]:
    """Edges that cut each feature into about equally many rows."""
    found = df.approxQuantile(FEATURES, [j / bins for j in range(1, bins)], 0.1 / bins)
    return {f: sorted(set(e)) for f, e in zip(FEATURES, found)}


def descend(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, levels: int) -> np.ndarray:
    """Node of every row after some levels, -1 if it has stopped at a leaf above."""
    node = np.zeros(len(x), np.int64)
    for _ in range(levels):
        split = np.where(node >= 0, feature[node], -1)
        right = x[np.arange(len(x)), split] >= threshold[node]
        node = np.where(split >= 0, 2 * node + 1 + right, -1)
    return node


def best_split(counts: np.ndarray) -> tuple[int, int] | None:
    """Feature and bin after which to cut, from counts (features x bins x classes); None if no cut makes the node purer."""
    left = counts.cumsum(axis=1)[:, :-1]
    right = counts.sum(axis=1, keepdims=True) - left
    nl, nr = left.sum(axis=2), right.sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        pure = (left * left).sum(axis=2) / nl + (right * right).sum(axis=2) / nr
    pure = np.where((nl > 0) & (nr > 0), pure, -1.0)
    if not pure.size:
        return None
    at = int(pure.argmax())
    whole = counts[0].sum(axis=0)
    return divmod(at, pure.shape[1]) if pure.flat[at] > (whole * whole).sum() / whole.sum() + 1e-9 else None


def _level_counts(points: DataFrame, trees: list, edges: list[np.ndarray], level: int, classes: int, folds: list[int]) -> DataFrame:
    """tree, node, place (feature, bin and class as one number), n of the nodes of a level."""
    sent = points.sparkSession.sparkContext.broadcast((trees, edges))
    first, width, bins = (1 << level) - 1, 1 << level, max(len(e) for e in edges) + 1

    def run(batches):
        grown, cuts = sent.value
        size = len(cuts) * bins * classes
        total = [np.zeros(width * size, np.int64) for _ in grown]
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES])
            label, fold = (batch.column(c).to_numpy() for c in ("label", "fold"))
            place = [(f * bins + np.searchsorted(c, x[:, f], "right")) * classes + label for f, c in enumerate(cuts)]
            for t, (feature, threshold) in enumerate(grown):
                node = descend(x, feature, threshold, level)
                mine = np.flatnonzero((fold != folds[t]) & (node >= 0))
                for p in place:
                    total[t] += np.bincount((node[mine] - first) * size + p[mine], minlength=width * size)
        for t, held in enumerate(total):
            at = np.flatnonzero(held)
            for a in range(0, len(at), 100_000):
                part = at[a : a + 100_000]
                columns = [np.full(len(part), t), part // size + first, part % size, held[part]]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["tree", "node", "place", "n"])

    return points.mapInArrow(run, "tree long, node long, place long, n long").groupBy("tree", "node", "place").agg(F.sum("n").alias("n"))


def grow(df: DataFrame, edges: dict[str, list[float]], depth: int = 6) -> DataFrame:
    """The nodes of one tree for each fold, grown from the rows of the other folds: ``tree`` is the fold left out.

    ``df`` has the features, ``prediction`` and ``fold``; rows with a missing or infinite feature, class or
    fold are left out. Leaves have no feature. At most folds x 2**depth nodes come to the driver.
    """
    spark = df.sparkSession
    rows = df.filter(usable() & F.col("prediction").isNotNull() & F.col("fold").isNotNull())
    met = rows.groupBy("prediction", "fold").count().collect()  # classes x folds rows
    labels, folds = sorted({r["prediction"] for r in met}), sorted({r["fold"] for r in met})
    number = F.array_position(F.array(*[F.lit(c) for c in labels]), F.col("prediction")) - 1 if labels else F.lit(0)
    points = rows.select(*[F.col(f).cast("double").alias(f) for f in FEATURES], number.cast("long").alias("label"), F.col("fold").cast("long").alias("fold"))
    cuts = [np.array(edges[f]) for f in FEATURES]
    bins, classes = max(len(c) for c in cuts) + 1, max(len(labels), 1)
    total = (2 << depth) - 1
    trees = [(np.full(total, -1), np.zeros(total)) for _ in folds]
    out: list[tuple] = []

    def split(table: pa.Table) -> pa.Table:
        counts = np.zeros(len(cuts) * bins * classes, np.int64)
        counts[table.column("place").to_numpy()] = table.column("n").to_numpy()
        counts = counts.reshape(len(cuts), bins, classes)
        found, whole = best_split(counts), counts[0].sum(axis=0)
        feature, cut = found or (-1, -1)
        said = {"tree": table.column("tree")[:1], "node": table.column("node")[:1], "feature": pa.array([feature], pa.int32())}
        return pa.table(said | {"cut": pa.array([cut], pa.int32()), "n": pa.array([int(whole.sum())]), "best": pa.array([int(whole.argmax())])})

    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for level in range(depth + 1):
            counts = _level_counts(points, trees, cuts, level, classes, folds)
            found = counts.groupBy("tree", "node").applyInArrow(split, "tree long, node long, feature int, cut int, n long, best long").collect()
            for r in found:
                feature, threshold = (r["feature"], float(cuts[r["feature"]][r["cut"]])) if r["feature"] >= 0 and level < depth else (None, None)
                out.append((folds[r["tree"]], r["node"], feature, threshold, r["n"], labels[r["best"]]))
                if feature is not None:
                    trees[r["tree"]][0][r["node"]], trees[r["tree"]][1][r["node"]] = feature, threshold
            if not any(r["feature"] >= 0 for r in found):
                break
    finally:
        points.unpersist()
    return spark.createDataFrame(sorted(out), NODES)


def tree_predictions(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """``df`` with the class ``guess`` of the tree of its fold: the row walks the node table inside an expression.

    A tree is one array in heap order; joining it needs no shuffle of ``df``. Rows with a missing feature or fold have no guess.
    """
    told = F.struct("feature", "threshold", "prediction")
    trees = nodes.groupBy(F.col("tree").alias("_fold")).agg(F.map_from_entries(F.collect_list(F.struct("node", told))).alias("tree"))
    x = F.array(*[F.col(f).cast("double") for f in FEATURES])

    def step(node: Column, _: Column) -> Column:
        here = F.element_at("tree", node)
        right = F.get(x, here["feature"]) >= here["threshold"]
        return F.when(here["feature"].isNull(), node).otherwise(2 * node + 1 + right.cast("long"))

    levels = F.expr("sequence(1, 1 + CAST(floor(log2(array_max(map_keys(tree)) + 1)) AS INT))")
    leaf = F.aggregate(levels, F.lit(0).cast("long"), step)
    joined = df.withColumn("_fold", F.col("fold").cast("long")).join(F.broadcast(trees), "_fold", "left")  # a row per fold
    guess = F.when(usable() & F.col("tree").isNotNull(), F.element_at("tree", leaf)["prediction"])
    return joined.withColumn("guess", guess).drop("_fold", "tree")
