"""From class probabilities to flagged sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.schemas import CERTAIN


def _labels(like: DataFrame, labels: DataFrame | list[int], name: str) -> DataFrame:
    """The labels as a one-column table to broadcast: there is at most one for each cluster of the model."""
    if isinstance(labels, list):
        labels = like.sparkSession.createDataFrame([(int(x),) for x in labels], "label bigint")
    return F.broadcast(labels.select(F.col("label").cast("bigint").alias(name)).distinct())


def verdict(prob: DataFrame, labels: DataFrame | list[int], min_prob: float = 0.0) -> DataFrame:
    """Rows with an anomalous class of probability above ``min_prob`` (any share counts).

    ``labels`` are the anomalous labels, as a list or a table with column ``label``.
    """
    likely = prob.filter(F.col("Prob") > min_prob)
    return likely.join(_labels(prob, labels, "Class"), "Class", "left_semi").select(*prob.columns)


def strict_verdict(predicted: DataFrame, labels: DataFrame | list[int], certain: float = CERTAIN) -> DataFrame:
    """Rows whose top class is anomalous, or whose top class is not certain."""
    known = _labels(predicted, labels, "Prediction").withColumn("bad", F.lit(True))
    marked = predicted.join(F.broadcast(known), "Prediction", "left")
    return marked.filter(F.col("bad") | (F.col("Probability") < certain)).select(*predicted.columns)


def anomaly_pairs(flagged: DataFrame) -> DataFrame:
    """Each flagged ``(srcAddr, vlanID)`` once, however many classes flagged it."""
    return flagged.select("srcAddr", "vlanID").distinct()


def mitigation_actions(pairs: DataFrame) -> DataFrame:
    """Flagged pairs as the JSON rows a network controller takes."""
    return pairs.select(F.to_json(F.struct("srcAddr", "vlanID")).alias("action")).distinct()


def normal_labels(predicted: DataFrame) -> DataFrame:
    """Labels that normal-only traffic is given."""
    return predicted.select(F.col("Prediction").alias("label")).distinct()


def anomalous_labels(labels: DataFrame, normal: DataFrame) -> DataFrame:
    """The remaining labels."""
    return labels.select("label").distinct().join(normal, "label", "left_anti")
