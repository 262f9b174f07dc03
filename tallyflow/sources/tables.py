"""Tables, files and streams the jobs read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.schemas import FEATURES
from tallyflow.sinks.tables import read_batches


def read_history(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All stored rows below a folder, committed or not; filters and columns reach the Parquet scan.

    With a declared ``schema`` no file is opened to find it, and the batch keys come typed. To follow the commit
    records of a job use ``sinks.commits.read_committed``.
    """
    if schema is not None:
        return read_batches(spark, path, schema)
    return spark.read.parquet(path)


def read_feature_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with the five features in any column order, and ``id`` / ``prediction`` if there."""
    rows = spark.read.option("header", True).csv(path)
    whole = [F.col(c).cast("bigint").alias(c) for c in ("id", "prediction") if c in rows.columns]
    return rows.select(*whole, *[F.col(f).cast("double").alias(f) for f in FEATURES])


def read_flow_stream(spark: SparkSession, source: str = "kafka", path: str | None = None, **options: str) -> DataFrame:
    """Unparsed messages as a stream with the column ``value``.

    ``kafka`` needs the Spark connector package on the session and the options
    ``kafka.bootstrap.servers`` and ``subscribe`` (topic ``flows`` by default).
    ``files`` reads text files, one message per line.
    """
    if source == "kafka":
        options = {"subscribe": "flows", "startingOffsets": "latest", **options}
        return spark.readStream.format("kafka").options(**options).load().select("value")
    if source == "files":
        return spark.readStream.options(**options).text(path).select("value")
    raise ValueError(f"source must be 'kafka' or 'files', not {source!r}")


def read_table_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One Parquet table of a folder as a stream of rows."""
    name = f"{table}.parquet"
    schema: T.StructType = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
