"""Tables and files the jobs write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.schemas import FLOW_MESSAGE

BATCHES_PER_GROUP = 1440  # a day of 60-second batches
BATCH_KEYS = ["day", "writer", "batchGroup", "batchId"]


def now_millis() -> Column:
    return F.unix_millis(F.current_timestamp())


def stamp(df: DataFrame, date: Column | None = None) -> DataFrame:
    """``df`` with the write time in milliseconds."""
    return df.withColumn("date", now_millis() if date is None else date)


def documents(df: DataFrame, date: Column | None = None) -> DataFrame:
    """Rows as ``(date, json)`` documents; the stamp is also inside the JSON."""
    stamped = stamp(df, date)
    fields = [c for c in stamped.columns if c != "date"]
    text = F.to_json(F.struct(*fields, "date"), {"ignoreNullFields": "false"})
    return stamped.select("date", text.alias("json"))


def append_batch(df: DataFrame, path: str, batch_id: int, writer: str, day: str) -> None:
    """Append one micro-batch; a repeated batch replaces itself, so nothing doubles.

    ``writer`` names the checkpoint that counts the batches, so jobs that share a folder,
    or a job that lost its checkpoint, never replace each other's batches. ``day``
    (of the batch's flows, hence the same in a repetition) comes first in the
    path: a time range opens only its days.
    """
    keyed = df.withColumns(
        {
            "day": F.lit(day).cast("date"),
            "writer": F.lit(writer),
            "batchGroup": F.lit(batch_id // BATCHES_PER_GROUP).cast("bigint"),
            "batchId": F.lit(batch_id).cast("bigint"),
        }
    )
    rows = keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    rows.partitionBy(*BATCH_KEYS).parquet(path)


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """History of a declared schema, with its batch keys; filters on ``day`` prune folders."""
    keys = [T.StructField("day", T.DateType()), T.StructField("writer", T.StringType())]
    keys += [T.StructField(c, T.LongType()) for c in ("batchGroup", "batchId")]
    return spark.read.schema(T.StructType([*schema.fields, *keys])).parquet(path)


def archive_rows(messages: DataFrame, value: str = "value", day: Column | None = None) -> DataFrame:
    """Whole messages as a nested ``flow``, with the day they came in.

    The message text itself is dropped, unless it is not JSON: then it is all there is.
    """
    text = F.col(value).cast("string")
    flow = F.try_parse_json(text)
    return messages.select(
        flow.alias("flow"),
        F.when(flow.isNull(), text).alias("message"),
        (F.current_date() if day is None else day).alias("ingestDate"),
    )


def archived_flows(archive: DataFrame) -> DataFrame:
    """Message fields read back from archived rows."""
    fields = [
        F.try_variant_get("flow", f"$.{f.name}", f.dataType.simpleString()).alias(f.name)
        for f in FLOW_MESSAGE.fields
    ]
    return archive.filter(F.col("flow").isNotNull()).select("ingestDate", *fields)


def write_archive(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("ingestDate").parquet(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header; ``single_file`` is for exports known to be small."""
    frame = df.coalesce(1) if single_file else df
    frame.write.mode("overwrite").option("header", True).csv(path)


def preview(df: DataFrame, rows: int = 12) -> DataFrame:
    return df.limit(rows)
