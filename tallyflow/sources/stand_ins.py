"""Flow and feature frames derived from the benchmark tables.

The tables hold no network traffic, so each frame maps a table's columns onto
flow fields. Epochs are read from zone-less timestamps, so the result does not
depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.schemas import FEATURES, FLOW

BATCH_WIDTH = 90 * 86400  # window of the order-line flows, in seconds
STREAM_WIDTH = 86400  # window of the event flows, in seconds


def flows_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow per order line: suppliers are sources, parts are destinations."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.selectExpr(
        "IF(l_suppkey = 0, '', concat('10.0.0.', l_suppkey)) AS srcAddr",
        "1024 + l_orderkey % 500 AS srcPort",
        "concat('10.1.', l_partkey div 256, '.', l_partkey % 256) AS dstAddr",
        "l_partkey % 100 AS dstPort",
        "l_orderkey div 4 AS sampledFlow",
        "CAST(l_linenumber * 2 AS BIGINT) AS tcpFlags",
        "CAST(CASE l_returnflag WHEN 'R' THEN 6 WHEN 'A' THEN 17 ELSE 1 END AS BIGINT) AS protocol",
        "unix_timestamp(l_shipdate) AS timestampStart",
        "unix_timestamp(l_shipdate) + l_linenumber AS timestampEnd",
        "CAST(floor(l_extendedprice) AS BIGINT) AS numBytes",
        "CAST(l_quantity AS BIGINT) AS numPackets",
        "CAST(100 + l_linenumber % 3 AS BIGINT) AS vlanID",
    )


def flows_from_events(events: DataFrame) -> DataFrame:
    """One flow per event; stateless, so ``events`` may be a stream."""
    return events.selectExpr(
        "concat('10.0.0.', user_id) AS srcAddr",
        "1024 + event_id % 500 AS srcPort",
        "concat('10.2.0.', event_id % 37) AS dstAddr",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS dstPort",
        "event_id div 3 AS sampledFlow",
        "event_id % 64 AS tcpFlags",
        "CAST(6 AS BIGINT) AS protocol",
        "unix_timestamp(ts) AS timestampStart",
        "unix_timestamp(ts) + 1 AS timestampEnd",
        "CAST(round(value * 100) AS BIGINT) AS numBytes",
        "1 + event_id % 7 AS numPackets",
        "100 + event_id % 5 AS vlanID",
    )


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def labelled_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled feature rows: five components, and their signs as the label."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    parts = [
        F.col("embedding")[i].cast("double").alias(name) for i, name in enumerate(FEATURES)
    ]
    label = sum(
        (F.col("embedding")[i] > 0).cast("bigint") * F.lit(1 << i) for i in range(3)
    )
    return vectors.select(F.col("vec_id").alias("id"), label.alias("prediction"), *parts)


def as_flow(df: DataFrame) -> DataFrame:
    """Columns of ``df`` in flow-record order and type."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FLOW.fields])
