"""Windows that a finished profile stream still holds in its state.

A run over all available input ends before the watermark has passed its last windows. They lie in the
checkpoint as values counted per window and address, which is what the second aggregation reads; so they
are read with the state reader and given the same second aggregation as a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.operators import profiles

KINDS = {
    "source": (["window", "srcAddr"], profiles.SOURCE_COUNTED, profiles.source_of_values),
    "dest": (["window", "dstAddr"], profiles.DEST_COUNTED, profiles.dest_of_values),
}


def _state(spark: SparkSession, checkpoint: str, operator: int) -> DataFrame:
    return spark.read.format("statestore").option("operatorId", operator).load(checkpoint)


def open_profiles(spark: SparkSession, checkpoint: str, kind: str = "source") -> DataFrame:
    """Profiles of the windows that are open in the checkpoint of a finished ``start_profile_stream`` (exact counts)."""
    by, counted, finish = KINDS[kind]
    operators = spark.read.format("state-metadata").load(checkpoint).select("operatorId").distinct().collect()
    found = {r["operatorId"]: _state(spark, checkpoint, r["operatorId"]) for r in operators}  # two of them
    values = [k for k, state in found.items() if set(counted) <= set(state.schema["key"].dataType.fieldNames())]
    if len(values) != 1:
        raise ValueError("not the checkpoint of an exact profile stream of this kind")
    for k, state in found.items():
        if k not in values and not state.isEmpty():
            raise RuntimeError("the run was cut off between its aggregations: start it once more")
    state = found[values[0]]
    sums = F.col("value").cast("struct<bytes:bigint,packets:bigint>")  # both are named alike in the state
    return finish(state.select("key.*", sums.alias("sums")).select("*", "sums.*").withColumnRenamed("spark_grouping_id", "grouping"), by)


def open_path(path: str) -> str:
    return path.rstrip("/") + "-open"


def finish_profiles(spark: SparkSession, path: str, checkpoint: str, kind: str = "source") -> None:
    """After a finished run: write its open windows beside its output, in place of those of an earlier run."""
    open_profiles(spark, checkpoint, kind).write.mode("overwrite").parquet(open_path(path))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Closed windows and those left open by the last finished run. A window that a later run closed counts as closed."""
    closed = spark.read.parquet(path)
    rest = spark.read.schema(closed.schema).parquet(open_path(path))
    return closed.unionByName(rest.join(closed.select("windowStart").distinct(), "windowStart", "left_anti"))
