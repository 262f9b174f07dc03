"""Score profiles with trained models; the same plan for a batch table and a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyflow.operators import features, verdict, voting
from tallyflow.plans.training import ModelBundle


def score(profile: DataFrame, bundle: ModelBundle, keep: list[str] | None = None) -> DataFrame:
    """Class probabilities of every profile with a source; identity columns ride along."""
    keep = keep or ["srcAddr", "vlanID"]
    rows = features.feature_frame(features.score_input(profile), keep=keep)
    scaled = features.scale(rows, bundle.scaler)
    return voting.knn_class_prob(scaled, bundle.neighbors, bundle.neighbors.k).select(*keep, "Class", "Prob")


def detect(profile: DataFrame, bundle: ModelBundle, min_prob: float = 0.0) -> DataFrame:
    """Flagged ``(srcAddr, vlanID)`` pairs."""
    flagged = verdict.verdict(score(profile, bundle), bundle.anomalous(), min_prob)
    return verdict.anomaly_pairs(flagged)
