"""From profiles to scaled model features."""

from __future__ import annotations

from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.columns import feature_cast
from tallyflow.schemas import FEATURES


def score_input(profile: DataFrame) -> DataFrame:
    """Profiles with a source address; rows without one stay in history only."""
    return profile.filter(F.col("srcAddr") != "")


def row_id(*key: str) -> Column:
    """Number of a row that depends on its key only, not on partitions or order."""
    return F.xxhash64(*key)


def feature_frame(df: DataFrame, id: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """``id`` and the features as 32-bit floats, in model order."""
    first = [] if id is None else [id.alias("id")]
    return df.select(*first, *(keep or []), *[feature_cast(f).alias(f) for f in FEATURES])


def unpack_documents(documents: DataFrame, column: str = "_2") -> DataFrame:
    """Feature columns of stored documents held as a map."""
    return documents.select(*[F.col(column).getItem(f).alias(f) for f in FEATURES])


def assemble(df: DataFrame, output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol=output).transform(df)


def fit_scaler(df: DataFrame) -> StandardScalerModel:
    """Scaler to unit sample deviation, without centring."""
    scaler = StandardScaler(inputCol="features", outputCol="scaledFeatures", withStd=True, withMean=False)
    return scaler.fit(assemble(df).select("features"))


def scale(df: DataFrame, model: StandardScalerModel, keep_vector: bool = False) -> DataFrame:
    """``df`` with the features replaced by their scaled values."""
    scaled = model.transform(assemble(df))
    parts = vector_to_array("scaledFeatures")
    others = [c for c in df.columns if c not in FEATURES]
    vector = ["scaledFeatures"] if keep_vector else []
    columns = [parts[i].alias(f) for i, f in enumerate(FEATURES)]
    return scaled.select(*others, *vector, *columns)


def scaler_stats(df: DataFrame, model: StandardScalerModel) -> DataFrame:
    """Deviation per feature of a fitted scaler."""
    rows = [(f, float(s)) for f, s in zip(FEATURES, model.std)]
    return df.sparkSession.createDataFrame(rows, "feature string, std double")
