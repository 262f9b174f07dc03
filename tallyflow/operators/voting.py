"""Class weights, probabilities and labels from neighbour lists, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.operators.neighbors import NeighborModel
from tallyflow.schemas import NEIGHBORS


def weight(entry: Column, nearest: Column, weights: str) -> Column:
    """Vote of a neighbour. At distance zero only the equal rows vote, one each."""
    if weights == "uniform":
        return F.lit(1.0)
    if weights != "distance":
        raise ValueError(f"weights must be 'distance' or 'uniform', not {weights!r}")
    equal = F.when(entry["dist"] == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(nearest == 0, equal).otherwise(F.lit(1.0) / entry["dist"])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _total(votes: Column) -> Column:
    return F.aggregate(votes, F.lit(0.0), lambda sum, v: sum + v["weight"])


def class_shares(neighbors: Column, weights: str = "distance") -> Column:
    """Array of ``(Class, Prob)`` in class order; classes without weight are left out."""

    def vote(entry: Column, nearest: Column) -> Column:
        return F.struct(entry["label"].alias("label"), weight(entry, nearest, weights).alias("weight"))

    def share(label: Column, votes: Column, total: Column) -> Column:
        mine = _total(F.filter(votes, lambda v: v["label"] == label))
        return F.struct(label.alias("Class"), (mine / total).alias("Prob"))

    def shares(votes: Column, total: Column) -> Column:
        classes = F.sort_array(F.array_distinct(F.transform(votes, lambda v: v["label"])))
        return F.filter(F.transform(classes, lambda c: share(c, votes, total)), lambda s: s["Prob"] > 0)

    # an empty list has no nearest entry: get() gives NULL there
    return let(
        F.get(neighbors, F.lit(0))["dist"],
        lambda nearest: let(
            F.transform(neighbors, lambda e: vote(e, nearest)),
            lambda votes: let(_total(votes), lambda total: shares(votes, total)),
        ),
    )


def top_class(shares: Column) -> Column:
    """Most probable class, the smallest one on ties."""
    ranked = F.transform(
        shares, lambda s: F.struct(F.round(s["Prob"], 12).alias("prob"), (-s["Class"]).alias("label"))
    )
    return -F.array_max(ranked)["label"]


def knn_shares(
    df: DataFrame, model: NeighborModel, k: int = NEIGHBORS, weights: str = "distance", apart: str | None = None
) -> DataFrame:
    """``df`` with its class probabilities as the array ``shares``."""
    found = model.neighbors(df, k, apart, lambda neighbors: class_shares(neighbors, weights))
    return found.withColumnRenamed("neighbors", "shares")


def knn_class_prob(df: DataFrame, model: NeighborModel, k: int = NEIGHBORS, weights: str = "distance") -> DataFrame:
    """One row per row of ``df`` and class of non-zero probability; all columns are kept."""
    rows = knn_shares(df, model, k, weights)
    # the outer form infers no filter on the array, which would work out the shares twice
    rows = rows.select(*df.columns, F.explode_outer("shares").alias("share"))
    return rows.select(*df.columns, "share.*").filter(F.col("Class").isNotNull())


def knn_predict(
    df: DataFrame, model: NeighborModel, k: int = NEIGHBORS, weights: str = "distance", apart: str | None = None
) -> DataFrame:
    """``df`` with the winning class and its probability."""
    rows = knn_shares(df, model, k, weights, apart)
    best = F.array_max(F.transform("shares", lambda s: s["Prob"]))
    return rows.select(*df.columns, top_class(F.col("shares")).alias("Prediction"), best.alias("Probability"))


def prob_wide(prob: DataFrame, classes: list[int], id: str = "id") -> DataFrame:
    """One column per class; absent classes are 0."""
    of = {c: F.when(F.col("Class") == c, F.col("Prob")).otherwise(F.lit(0.0)) for c in classes}
    return prob.groupBy(id).agg(*[F.sum(share).alias(f"p{c}") for c, share in of.items()])


def prob_array(prob: DataFrame, classes: list[int], id: str = "id") -> DataFrame:
    """All class probabilities of a row as one array in class order."""
    wide = prob_wide(prob, classes, id)
    return wide.select(id, F.array(*[F.col(f"p{c}") for c in classes]).alias("probabilities"))


def second_class_prob(prob: DataFrame, classes: list[int], id: str = "id") -> DataFrame:
    """Probability of the second class only."""
    return prob_wide(prob, classes, id).select(id, F.col(f"p{classes[1]}").alias("probability"))
