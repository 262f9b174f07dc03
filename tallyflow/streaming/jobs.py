"""Structured Streaming jobs: collection, detection, event-time profiles, archive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyflow.operators import profiles, verdict
from tallyflow.operators.flows import normalize_flows, parse_flows, split_parsed
from tallyflow.plans.detection import detect
from tallyflow.plans.training import ModelBundle
from tallyflow.schemas import BATCH_SECONDS
from tallyflow.session import scratch_tables
from tallyflow.sinks.commits import commit_batch, is_committed
from tallyflow.sinks.tables import append_batch, archive_rows, stamp


NO_DAY = "1970-01-01"


def with_event_time(flows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Event time and watermark from the start of the flow; later flows are dropped."""
    timed = flows.withColumn("eventTime", F.timestamp_seconds("timestampStart"))
    return timed.withWatermark("eventTime", delay)


def _start(stream: DataFrame, checkpoint: str, once: bool, name: str | None = None):
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    if once:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{BATCH_SECONDS} seconds")


def start_profile_stream(
    flows: DataFrame,
    path: str,
    checkpoint: str,
    kind: str = "source",
    seconds: int = BATCH_SECONDS,
    delay: str = "10 minutes",
    approx: bool = False,
    once: bool = False,
) -> StreamingQuery:
    """Event-time profiles; a window is written when the watermark has passed it."""
    build = {"source": profiles.source_profile, "dest": profiles.dest_profile}[kind]
    profile = build(with_event_time(flows, delay), seconds, approx)
    writer = _start(profile, checkpoint, once).outputMode("append").format("parquet")
    return writer.option("path", path).start()


Append = Callable[[DataFrame, str], None]


def _on_batch(messages: DataFrame, out: str, strict: bool, work: Callable[[DataFrame, Append], None]):
    """Decode a batch once; rejected messages go to ``out/rejected``, the others to ``work``.

    Batches are kept under the id of the streaming query, which lives in its
    checkpoint, and under the day of the newest flow (the first day of all for a batch
    without any), so a repeated batch finds its own place again. All tables of a batch become
    readable by its commit record, written last; a batch that has one is not worked on again.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        writer = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if is_committed(spark, out, writer, batch_id):
            return
        tables: list[str] = []
        parsed = parse_flows(batch, strict=strict).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            valid, rejected = split_parsed(parsed)
            flows = normalize_flows(valid)
            newest = F.date_format(F.timestamp_seconds(F.max("timestampStart")), "yyyy-MM-dd")
            day = flows.agg(newest.alias("day")).first()["day"]

            def append(df: DataFrame, table: str) -> None:
                append_batch(df, f"{out}/{table}", batch_id, writer, day or NO_DAY)
                tables.append(table)

            if not rejected.isEmpty():
                append(stamp(rejected), "rejected")
            if day:
                work(flows, append)
            if tables:
                commit_batch(spark, out, writer, batch_id, day or NO_DAY, tables)
        finally:
            parsed.unpersist()

    return run


def start_collection(
    messages: DataFrame, out: str, checkpoint: str, strict: bool = False, once: bool = False
) -> StreamingQuery:
    """Per batch: source and destination profiles into history."""

    def work(flows: DataFrame, append: Append) -> None:
        append(stamp(profiles.source_profile(flows, None)), "source")
        append(stamp(profiles.dest_profile(flows, None)), "dest")

    return _start(messages, checkpoint, once).foreachBatch(_on_batch(messages, out, strict, work)).start()


def start_detection(
    messages: DataFrame,
    bundle: ModelBundle,
    out: str,
    checkpoint: str,
    strict: bool = False,
    once: bool = False,
) -> StreamingQuery:
    """Collection, then scoring: flagged pairs into anomalies and the mitigation feed.

    It keeps its own history, so give it another folder than a collection of the
    same messages, or every batch is in history twice (under two writers).
    """

    def work(flows: DataFrame, append: Append) -> None:
        source = profiles.source_profile(flows, None).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            append(stamp(source), "source")
            append(stamp(profiles.dest_profile(flows, None)), "dest")
            with scratch_tables(flows.sparkSession):
                pairs = detect(source, bundle).persist(StorageLevel.MEMORY_AND_DISK)
                try:
                    if not pairs.isEmpty():
                        append(stamp(pairs), "anomalies")
                        append(verdict.mitigation_actions(pairs), "mitigation")
                finally:
                    pairs.unpersist()
        finally:
            source.unpersist()

    return _start(messages, checkpoint, once).foreachBatch(_on_batch(messages, out, strict, work)).start()


def start_archive(messages: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Every message, unaggregated, in one folder per day; runs beside the other jobs."""
    writer = _start(archive_rows(messages), checkpoint, once).outputMode("append").format("parquet")
    return writer.partitionBy("ingestDate").option("path", path).start()
