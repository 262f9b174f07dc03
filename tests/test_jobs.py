"""Streams, sinks, stored models: stream = batch, restart, repeated batches."""

import json

import pytest
from pyspark.sql import functions as F

from tallyflow.operators import features, profiles, tuning
from tallyflow.operators.flows import decode_flows, encode_flows, normalize_flows
from tallyflow.plans import detection
from tallyflow.plans.training import ModelBundle, label_history, train
from tallyflow.schemas import DEST_PROFILE, ANOMALY, CLASS_PROB, FEATURES, LABELLED, SOURCE_PROFILE
from tallyflow.session import build_session, materialize, work_folder
from tallyflow.sinks import tables as sinks
from tallyflow.sources import tables as sources
from tallyflow.sources.stand_ins import flows_from_events, flows_from_lineitem, read_events
from tallyflow.streaming import jobs
from tests.conftest import SMALL

DAY = 86400


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def flows(spark):
    return materialize(flows_from_events(read_events(spark, SMALL)), "test-flows")


def write_messages(flows, folder, low, high):
    """One text file with the messages of event times in [low, high)."""
    part = flows.filter((F.col("timestampStart") >= low) & (F.col("timestampStart") < high))
    lines = [r.value for r in encode_flows(part.orderBy("timestampStart")).collect()]
    folder.mkdir(exist_ok=True)
    (folder / f"{low}.json").write_text("\n".join(lines))


def thirds(flows):
    low, high = flows.agg(F.min("timestampStart"), F.max("timestampStart")).first()
    step = (high - low) // 3 + 1
    return [(low + i * step, low + (i + 1) * step) for i in range(3)]


def stream_flows(spark, folder):
    messages = sources.read_flow_stream(spark, "files", str(folder), maxFilesPerTrigger="1", latestFirst="false")
    return normalize_flows(decode_flows(messages)[0])


@pytest.mark.parametrize("kind", ["source", "dest"])
@pytest.mark.parametrize("approx", [False, True])
def test_event_time_profiles_equal_batch_on_closed_windows(spark, flows, tmp_path, kind, approx):
    for low, high in thirds(flows):
        write_messages(flows, tmp_path / "in", low, high)
    run = jobs.start_profile_stream(
        stream_flows(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"),
        kind, DAY, "1 hour", approx, once=True,
    )
    run.awaitTermination(300)
    build = {"source": profiles.source_profile, "dest": profiles.dest_profile}[kind]
    last = flows.agg(F.max("timestampStart")).first()[0]
    closed = F.col("windowStart") + DAY <= last - 3600
    batch = build(flows, DAY).filter(closed)
    got = spark.read.parquet(str(tmp_path / "out"))
    if not approx:
        assert rows(got) == rows(batch) and got.count() > 0
    else:
        assert got.count() == batch.count()


def test_late_flow_is_dropped_in_event_time_and_counted_per_batch(spark, flows, tmp_path):
    (low, middle), _, (_, high) = thirds(flows)
    write_messages(flows, tmp_path / "in", middle, high)
    start = lambda: jobs.start_profile_stream(
        stream_flows(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), "dest", DAY, "1 hour", once=True
    )
    start().awaitTermination(300)
    write_messages(flows, tmp_path / "in", low, middle)
    start().awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out"))
    late_days = flows.filter(F.col("timestampStart") < middle - 2 * DAY).select(
        (F.col("timestampStart") - F.col("timestampStart") % DAY).alias("windowStart")
    ).distinct()
    assert got.join(late_days, "windowStart").count() == 0

    messages = sources.read_flow_stream(spark, "files", str(tmp_path / "in"))
    jobs.start_collection(messages, str(tmp_path / "col"), str(tmp_path / "col-cp"), once=True).awaitTermination(300)
    stored = sources.read_history(spark, str(tmp_path / "col/dest"))
    assert stored.agg(F.sum("destSumOfBytes")).first()[0] == flows.agg(F.sum("numBytes")).first()[0]


def test_collection_resumes_without_loss_or_doubles(spark, flows, tmp_path):
    parts = thirds(flows)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    messages = lambda: sources.read_flow_stream(spark, "files", str(tmp_path / "in"), maxFilesPerTrigger="1")
    for low, high in parts[:2]:
        write_messages(flows, tmp_path / "in", low, high)
    jobs.start_collection(messages(), out, cp, once=True).awaitTermination(300)
    write_messages(flows, tmp_path / "in", *parts[2])
    jobs.start_collection(messages(), out, cp, once=True).awaitTermination(300)
    got = sources.read_history(spark, f"{out}/source").drop("date", *sinks.BATCH_KEYS)
    want = [
        profiles.source_profile(flows.filter((F.col("timestampStart") >= a) & (F.col("timestampStart") < b)), None)
        for a, b in parts
    ]
    assert rows(got) == rows(want[0].union(want[1]).union(want[2]))
    assert got.columns == SOURCE_PROFILE.fieldNames()


def test_repeated_batch_replaces_itself(spark, flows, tmp_path):
    profile = profiles.dest_profile(flows, None)
    path = str(tmp_path / "history")
    for batch in (0, 1, 1, 1440):
        sinks.append_batch(sinks.stamp(profile), path, batch, "one", "2024-01-0" + str(1 + batch // 1440))
    sinks.append_batch(sinks.stamp(profile), path, 1, "two", "2024-01-01")
    stored = sinks.read_batches(spark, path, DEST_PROFILE)
    assert stored.count() == 4 * profile.count()
    plan = stored.filter("day = '2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_jobs_share_a_folder_and_bad_messages_are_kept(spark, flows, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    good = [r.value for r in encode_flows(flows.limit(20)).collect()]
    null = json.dumps({**json.loads(good[0]), "Bytes": None})
    (folder / "a.json").write_text("\n".join([*good, "bad", null]))
    for cp in ("one", "two"):
        messages = sources.read_flow_stream(spark, "files", str(folder))
        jobs.start_collection(messages, out, str(tmp_path / cp), once=True).awaitTermination(300)
    stored = sources.read_history(spark, f"{out}/source")
    assert stored.select("writer").distinct().count() == 2
    assert stored.agg(F.countDistinct("srcAddr", "vlanID")).first()[0] * 2 == stored.count()
    assert sorted(r.value for r in spark.read.parquet(f"{out}/rejected").collect()) == sorted(["bad", null] * 2)
    (folder / "b.json").write_text("worse")
    messages = sources.read_flow_stream(spark, "files", str(folder))
    jobs.start_collection(messages, out, str(tmp_path / "one"), once=True).awaitTermination(300)
    assert spark.read.parquet(f"{out}/rejected").filter("value = 'worse'").count() == 1


@pytest.fixture(scope="module")
def trained(spark):
    profile = materialize(profiles.source_profile(flows_from_lineitem(spark, SMALL), 90 * DAY), "test-profile")
    history = features.score_input(profile)
    normal = history.filter(F.col("sumOfBytes") < history.approxQuantile("sumOfBytes", [0.2], 0.01)[0])
    return profile, train(history, normal, ["windowStart", "srcAddr", "vlanID"], clusters=8)


def test_training_marks_labels_and_survives_storage(spark, trained, tmp_path):
    profile, bundle = trained
    marks = {r.label: r.is_normal for r in bundle.labels.collect()}
    assert set(marks) == set(range(8)) and set(marks.values()) == {True, False}
    bundle.save(str(tmp_path / "bundle"))
    loaded = ModelBundle.load(spark, str(tmp_path / "bundle"))
    assert rows(detection.detect(profile, loaded)) == rows(detection.detect(profile, bundle))


def test_detection_flags_what_holds_an_anomalous_class(spark, trained):
    profile, bundle = trained
    scored = detection.score(profile, bundle, ["windowStart", "srcAddr", "vlanID"])
    assert scored.columns[3:] == CLASS_PROB.fieldNames()[1:]
    bad = {r.label for r in bundle.anomalous().collect()}
    want = {(r.srcAddr, r.vlanID) for r in scored.collect() if r.Class in bad and r.Prob > 0}
    pairs = detection.detect(profile, bundle)
    assert pairs.columns == ANOMALY.fieldNames()
    assert {tuple(r) for r in pairs.collect()} == want and want
    assert "" not in {a for a, _ in want}


def test_detection_stream(spark, trained, tmp_path):
    _, bundle = trained
    flows = flows_from_lineitem(spark, SMALL)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(r.value for r in encode_flows(flows).collect()) + "\nbad")
    out = str(tmp_path / "out")
    messages = sources.read_flow_stream(spark, "files", str(folder))
    jobs.start_detection(messages, bundle, out, str(tmp_path / "cp"), once=True).awaitTermination(600)
    source = profiles.source_profile(flows, None)
    assert rows(spark.read.parquet(f"{out}/source").select(source.columns)) == rows(source)
    assert spark.read.parquet(f"{out}/source").filter("srcAddr = ''").count() > 0
    want = rows(detection.detect(source, bundle))
    assert rows(spark.read.parquet(f"{out}/anomalies").select("srcAddr", "vlanID")) == want
    actions = [json.loads(r.action) for r in spark.read.parquet(f"{out}/mitigation").collect()]
    assert sorted((a["srcAddr"], a["vlanID"]) for a in actions) == want


def test_strict_stream_fails_on_a_bad_message(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("bad")
    messages = sources.read_flow_stream(spark, "files", str(folder))
    run = jobs.start_collection(messages, str(tmp_path / "out"), str(tmp_path / "cp"), strict=True, once=True)
    with pytest.raises(Exception, match="bad flow message"):
        run.awaitTermination(300)


def test_archive_keeps_every_message(spark, flows, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [r.value for r in encode_flows(flows.limit(50)).collect()]
    (folder / "a.json").write_text("\n".join([*lines, '{"SrcAddr": "z", "Extra": {"deep": 1}}', "bad"]))
    messages = sources.read_flow_stream(spark, "files", str(folder))
    jobs.start_archive(messages, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(300)
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.count() == 52
    assert [r.message for r in stored.filter("message IS NOT NULL").collect()] == ["bad"]
    deep = stored.select(F.try_variant_get("flow", "$.Extra.deep", "int").alias("d")).filter("d = 1")
    assert deep.count() == 1
    assert sinks.archived_flows(stored).filter("Bytes IS NOT NULL").count() == 50


def test_documents_hold_their_stamp(spark, flows):
    docs = sinks.documents(profiles.dest_profile(flows.limit(5), None)).collect()
    for d in docs:
        body = json.loads(d.json)
        assert body["date"] == d.date and d.date > 1_600_000_000_000 and "dstAddr" in body


def test_csv_round_trip_in_any_column_order(spark, tmp_path):
    df = spark.range(20).select("id", (F.col("id") % 3).alias("prediction"), *[(F.rand(1) * 9).alias(f) for f in FEATURES])
    df = materialize(df, "csv-rows")
    sinks.write_csv(df.select(*reversed(df.columns)), str(tmp_path / "csv"), single_file=True)
    back = sources.read_feature_csv(spark, str(tmp_path / "csv"))
    assert back.columns == LABELLED.fieldNames()
    assert rows(back) == rows(df)


def test_labelled_history_matches_its_schema(spark, trained):
    profile, _ = trained
    _, labelled = label_history(features.score_input(profile), ["windowStart", "srcAddr", "vlanID"], k=3)
    assert set(labelled.columns) == set(LABELLED.fieldNames())
    assert labelled.select("id").distinct().count() == labelled.count()
    assert tuning.holdout_split(labelled).filter("part = 'test'").count() > 0


def test_kafka_source_needs_its_package_and_unknown_source_is_refused(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        sources.read_flow_stream(spark, "kafka", **{"kafka.bootstrap.servers": "localhost:1"})
    with pytest.raises(ValueError):
        sources.read_flow_stream(spark, "socket")


def test_preview_and_session_helpers(spark):
    assert sinks.preview(spark.range(100)).count() == 12
    assert work_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert build_session().conf.get("spark.sql.session.timeZone") == "UTC"
