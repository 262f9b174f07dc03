"""Splits, folds and score curves; one neighbour pass serves every k."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.functions.columns import HASH_SPACE, hash32
from tallyflow.operators.neighbors import NeighborModel
from tallyflow.operators.voting import let, top_class, weight
from tallyflow.schemas import CV_FOLDS, CV_KS, HOLDOUT_KS


SLICE_ROWS = 1_000_000


def holdout_split(df: DataFrame, share: float = 0.75, seed: int = 0, id: str = "id") -> DataFrame:
    """``df`` with ``part`` = train or test, decided by a hash of the id alone."""
    train = hash32(seed, F.col(id)) < int(share * HASH_SPACE)
    return df.withColumn("part", F.when(train, F.lit("train")).otherwise(F.lit("test")))


def shuffled_folds(df: DataFrame, folds: int, seed: int, id: str = "id") -> DataFrame:
    """``df`` with a pseudo-random ``fold``, the same under any partitioning."""
    return df.withColumn("fold", hash32(seed, F.col(id)) % folds)


def stratified_folds(
    df: DataFrame, folds: int = CV_FOLDS, label: str = "prediction", id: str = "id", slices: int | None = None
) -> DataFrame:
    """``df`` with ``fold``: rows of a class, in id order, dealt out in turn.

    The position of a row in its class is its position in a slice of the id range
    plus the class's rows in earlier slices, so a class of any size is ranked by
    many tasks. Slice edges only spread the work; the result does not depend on them.
    By default there is one slice for every ``SLICE_ROWS`` rows.
    """
    slices = max(1, df.count() // SLICE_ROWS) if slices is None else slices
    shares = [i / slices for i in range(1, slices)]
    cuts = df.approxQuantile(id, shares, 0.5 / slices) if shares else []
    edges = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>")
    sliced = df.withColumn("slice", F.size(F.filter(edges, lambda e: e < F.col(id))))
    sizes = sliced.groupBy(label, "slice").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(label).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(label, "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(label, "slice").orderBy(id))
    ranked = sliced.withColumn("own", own).join(offsets, [label, "slice"])
    return ranked.select(*df.columns, ((F.col("before") + F.col("own") - 1) % folds).alias("fold"))


def curve_winners(neighbors: Column, weights: str = "distance") -> Column:
    """Winning class for every k up to the length of a neighbour list, as an array: position i is k = i + 1.

    The list is folded once, inside its row: the state holds every class's weight so far and the winners.
    Ties are those of ``knn_predict``.
    """

    def step(held: Column, vote: Column) -> Column:
        total = held["total"] + vote["weight"]
        added = F.transform(
            held["sums"],
            lambda s: F.struct(
                s["label"].alias("label"),
                (s["sum"] + F.when(s["label"] == vote["label"], vote["weight"]).otherwise(F.lit(0.0))).alias("sum"),
            ),
        )
        shares = lambda sums: F.transform(sums, lambda s: F.struct(s["label"].alias("Class"), (s["sum"] / total).alias("Prob")))
        return let(
            added,
            lambda sums: F.struct(
                sums.alias("sums"), total.alias("total"), F.array_append(held["winners"], top_class(shares(sums))).alias("winners")
            ),
        )

    def fold(votes: Column) -> Column:
        labels = F.array_distinct(F.transform(votes, lambda v: v["label"]))
        start = F.struct(
            F.transform(labels, lambda c: F.struct(c.alias("label"), F.lit(0.0).alias("sum"))).alias("sums"),
            F.lit(0.0).alias("total"),
            F.array().cast("array<bigint>").alias("winners"),
        )
        return F.aggregate(votes, start, step, lambda held: held["winners"])

    def vote(entry: Column, nearest: Column) -> Column:
        return F.struct(entry["label"].alias("label"), weight(entry, nearest, weights).alias("weight"))

    nearest = F.get(neighbors, F.lit(0))["dist"]
    return let(nearest, lambda n: let(F.transform(neighbors, lambda e: vote(e, n)), fold))


def curve_predictions(found: DataFrame, keep: list[str], id: str = "id", weights: str = "distance") -> DataFrame:
    """Winning class of every row for every k, from neighbour lists of the largest k."""
    winners = found.select(id, *keep, F.posexplode(curve_winners(F.col("neighbors"), weights)).alias("pos", "Prediction"))
    return winners.select(id, *keep, (F.col("pos") + 1).alias("k"), "Prediction")


def _curve(found: DataFrame, ks: list[int], by: list[str], weights: str) -> DataFrame:
    """``by``, k, error, accuracy. Rows are counted where they lie, all k at a time; nothing but counts is shuffled.

    A row with fewer than k neighbours does not count for k.
    """
    rows = found.select(*by, "prediction_true", curve_winners(F.col("neighbors"), weights).alias("winners"))
    guess = {k: F.get("winners", F.lit(k - 1)) for k in ks}
    right = [F.count(F.when(guess[k] == F.col("prediction_true"), 1)).alias(f"right{k}") for k in ks]
    counted = rows.groupBy(*by).agg(*right, *[F.count(guess[k]).alias(f"n{k}") for k in ks])
    line = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"right{k}").alias("right"), F.col(f"n{k}").alias("n")) for k in ks]))
    lines = counted.select(*by, line.alias("line")).select(*by, "line.*").filter("n > 0")
    return lines.select(*by, "k", ((F.col("n") - F.col("right")) / F.col("n")).alias("error"), (F.col("right") / F.col("n")).alias("accuracy"))


def knn_cv_scores(
    df: DataFrame, ks: Iterable[int] = CV_KS, id: str = "id", weights: str = "distance", **limits: int
) -> DataFrame:
    """Accuracy per k and fold. ``df`` has a ``fold``; a row's neighbours come from the other folds."""
    ks = list(ks)
    model = NeighborModel.fit(df, k=max(ks), id=id, apart="fold", **limits)
    found = model.neighbors(df.withColumnRenamed("prediction", "prediction_true"), apart="fold")
    return _curve(found, ks, ["fold"], weights).drop("error")


def knn_cv_curve(df: DataFrame, ks: Iterable[int] = CV_KS, **options) -> DataFrame:
    """Mean fold accuracy per k."""
    return knn_cv_scores(df, ks, **options).groupBy("k").agg(F.avg("accuracy").alias("accuracy"))


def knn_holdout_curve(
    train: DataFrame, test: DataFrame, ks: Iterable[int] = HOLDOUT_KS, id: str = "id", weights: str = "distance", **limits: int
) -> DataFrame:
    """Error rate and accuracy per k on the held-out rows."""
    ks = list(ks)
    model = NeighborModel.fit(train, k=max(ks), id=id, **limits)
    found = model.neighbors(test.withColumnRenamed("prediction", "prediction_true"))
    return _curve(found, ks, [], weights)


def score_summary(scores: DataFrame, by: str = "model", score: str = "accuracy") -> DataFrame:
    """Mean and population deviation of the fold scores."""
    return scores.groupBy(by).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))


def fold_spread(scores: DataFrame, by: str = "model", score: str = "accuracy") -> DataFrame:
    """Five-number summary of the fold scores, the data of a box plot."""
    at = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    return scores.groupBy(by).agg(*[F.percentile(score, p).alias(n) for n, p in at.items()])
