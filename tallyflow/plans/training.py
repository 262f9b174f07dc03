"""Train the detection models from profile history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import StandardScalerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.operators import clustering, features, tuning, verdict, voting
from tallyflow.operators.neighbors import NeighborModel
from tallyflow.schemas import CLUSTERS, KMEANS_SEED, NEIGHBORS
from tallyflow.session import materialize


@dataclass
class ModelBundle:
    """Scaler, neighbour model, and the label table ``(label, is_normal)``."""

    scaler: StandardScalerModel
    neighbors: NeighborModel
    labels: DataFrame

    def anomalous(self) -> DataFrame:
        return self.labels.filter(~F.col("is_normal")).select("label")

    def save(self, path: str) -> None:
        self.scaler.write().overwrite().save(f"{path}/scaler")
        self.neighbors.save(f"{path}/neighbors")
        self.labels.coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ModelBundle":
        return cls(
            StandardScalerModel.load(f"{path}/scaler"),
            NeighborModel.load(spark, f"{path}/neighbors"),
            spark.read.parquet(f"{path}/labels"),
        )


def label_history(history: DataFrame, key: list[str], k: int = CLUSTERS, seed: int = KMEANS_SEED):
    """``(scaler, labelled)``: scaled history rows with their K-means cluster.

    The narrow feature table is written once; every later pass reads only that.
    """
    rows = materialize(features.feature_frame(history, features.row_id(*key)), "features")
    scaler = features.fit_scaler(rows)
    scaled = features.scale(rows, scaler)
    return scaler, clustering.label(scaled, clustering.fit_kmeans(scaled, k, seed))


def train(
    history: DataFrame,
    normal: DataFrame,
    key: list[str],
    clusters: int = CLUSTERS,
    neighbors: int = NEIGHBORS,
    seed: int = KMEANS_SEED,
) -> ModelBundle:
    """Models from all history; labels met by the ``normal`` rows are normal, the rest anomalous."""
    scaler, labelled = label_history(history, key, clusters, seed)
    training = tuning.holdout_split(labelled).filter(F.col("part") == "train")
    model = NeighborModel.fit(training, k=neighbors)
    scaled = features.scale(features.feature_frame(normal), scaler)
    met = verdict.normal_labels(voting.knn_predict(scaled, model, neighbors))
    known = model.rows.select("label").distinct()
    labels = known.join(met.withColumn("met", F.lit(True)), "label", "left")
    labels = labels.select("label", F.coalesce("met", F.lit(False)).alias("is_normal"))
    fixed = [tuple(r) for r in labels.collect()]  # one row per cluster
    table = history.sparkSession.createDataFrame(fixed, "label bigint, is_normal boolean")
    return ModelBundle(scaler, model, table)
