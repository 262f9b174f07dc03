"""Scaler statistics that are kept per day and merged.

A day's moments (count, mean, sum of squared deviations of every feature) are merged in parallel form, so
training again reads only days that are new or have changed, and equals a fit over the whole history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions.columns import feature_cast
from tallyflow.schemas import FEATURES


def feature_moments(df: DataFrame, by: list[str]) -> DataFrame:
    """``by``, feature, n, mean, m2: one scan, combined before the shuffle. A NULL feature is not counted."""
    casts = {f: feature_cast(f).cast("double") for f in FEATURES}
    parts = [
        F.struct(
            F.lit(f).alias("feature"),
            F.count(c).alias("n"),
            F.avg(c).alias("mean"),
            (F.var_pop(c) * F.count(c)).alias("m2"),
        )
        for f, c in casts.items()
    ]
    counted = df.groupBy(*by).agg(F.array(*parts).alias("parts"))
    return counted.select(*by, F.inline("parts")).filter("n > 0")


def merged_moments(moments: DataFrame) -> DataFrame:
    """feature, n, mean, m2 of all parts together: the spread of the means about the joint one is added to the parts' own."""
    joint = moments.groupBy("feature").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("joint"))  # one row per feature
    around = F.col("mean") - F.col("joint")
    rows = moments.join(F.broadcast(joint), "feature")
    return rows.groupBy("feature").agg(
        F.sum("n").alias("n"), F.first("joint").alias("mean"), F.sum(F.col("m2") + F.col("n") * around * around).alias("m2")
    )


def deviations(moments: DataFrame) -> DataFrame:
    """feature, std: the sample deviation, 0 for a single row."""
    return merged_moments(moments).select("feature", F.coalesce(F.sqrt(F.try_divide("m2", F.col("n") - 1)), F.lit(0.0)).alias("std"))


def scale_by(df: DataFrame, stds: DataFrame) -> DataFrame:
    """``df`` with the features divided by their deviations (five rows); a constant feature becomes 0."""
    known = {r["feature"]: r["std"] for r in stds.collect()}
    scaled = {f: F.col(f) * F.lit(1.0 / known[f]) if known.get(f) else F.col(f) * F.lit(0.0) for f in FEATURES}
    return df.withColumns({f: c.cast("double") for f, c in scaled.items()})


def refresh(
    spark: SparkSession, path: str, versions: dict[str, str], read_days: Callable[[list[str]], DataFrame]
) -> tuple[DataFrame, list[str]]:
    """Stored moments of all days, and the days that had to be read.

    ``versions`` names the state of every day of the history (for instance a hash of its folders);
    a day is read if it is not stored in that state, and what is stored of it is replaced as a whole.
    ``read_days`` gives the rows of some days with the day as the text ``day``; all are read in one job.
    """
    schema = "feature string, n long, mean double, m2 double, version string, day string"
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)
    stored = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
    known = {(r["day"], r["version"]) for r in stored.select("day", "version").distinct().collect()}  # a row per day
    stale = sorted(d for d, v in versions.items() if (d, v) not in known)
    if stale:
        states = spark.createDataFrame([(d, versions[d]) for d in stale], "day string, version string")
        rows = feature_moments(read_days(stale), ["day"]).join(F.broadcast(states), "day")
        rows = rows.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        rows.partitionBy("day").parquet(path)
        stored = spark.read.schema(schema).parquet(path)
    return stored.filter(F.col("day").isin(list(versions))).drop("version"), stale
