"""Commit records, compaction under the list of folders, and windows read from state."""

import threading

import pytest
from pyspark.sql import functions as F

from tallyflow.operators import profiles
from tallyflow.operators.flows import encode_flows
from tallyflow.schemas import DEST_PROFILE, SOURCE_PROFILE
from tallyflow.sinks import commits
from tallyflow.sinks.tables import append_batch
from tallyflow.sources import tables as sources
from tallyflow.sources.stand_ins import flows_from_events, read_events
from tallyflow.streaming import jobs, open_windows
from tests.conftest import SMALL
from tests.test_jobs import DAY, flows, rows, stream_flows, thirds, write_messages  # noqa: F401

DAYS = ["2024-01-01", "2024-01-02", "2024-01-03"]


def write_batch(spark, root, writer, batch, day, tables=("dest",), commit=True):
    df = spark.range(batch * 10, batch * 10 + 5).selectExpr("concat('a', id) AS dstAddr", *[f"id AS {c}" for c in DEST_PROFILE.fieldNames()[1:]])
    for table in tables:
        append_batch(df, f"{root}/{table}", batch, writer, day)
    if commit:
        commits.commit_batch(spark, root, writer, batch, day, list(tables))


def seen(spark, root, **days):
    return sorted((r.writer, r.batchId, r.dstAddr) for r in commits.read_committed(spark, root, "dest", DEST_PROFILE, **days).collect())


def expected(batches):
    return sorted((w, b, f"a{i}") for w, b in batches for i in range(b * 10, b * 10 + 5))


def test_a_batch_is_readable_with_all_its_tables_or_not_at_all(spark, tmp_path):
    root = str(tmp_path)
    assert commits.read_committed(spark, root, "dest", DEST_PROFILE).count() == 0
    write_batch(spark, root, "w", 0, DAYS[0], ("dest", "source"))
    write_batch(spark, root, "w", 1, DAYS[0], ("dest",), commit=False)  # killed before its second table
    assert seen(spark, root) == expected([("w", 0)])
    write_batch(spark, root, "w", 1, DAYS[0], ("dest", "source"))  # its repetition
    assert seen(spark, root) == expected([("w", 0), ("w", 1)])
    assert commits.is_committed(spark, root, "w", 1) and not commits.is_committed(spark, root, "w", 2)


def test_compaction_keeps_rows_and_keys_and_days_choose_folders(spark, tmp_path):
    root = str(tmp_path)
    batches = [("v", 0, DAYS[0]), ("v", 1, DAYS[0]), ("w", 0, DAYS[0]), ("w", 1, DAYS[1]), ("w", 2, DAYS[2])]
    for writer, batch, day in batches:
        write_batch(spark, root, writer, batch, day)
    want = expected([b[:2] for b in batches])
    assert commits.compact_closed(spark, root, "dest", DEST_PROFILE, today=DAYS[2]) == DAYS[:2]
    assert seen(spark, root) == want
    assert len(commits.folders_of(spark, root, "dest")) == 3
    assert commits.compact_closed(spark, root, "dest", DEST_PROFILE, today=DAYS[2]) == []
    write_batch(spark, root, "w", 3, DAYS[0])  # late for a closed day
    assert seen(spark, root, until=DAYS[0]) == expected([("v", 0), ("v", 1), ("w", 0), ("w", 3)])
    assert commits.compact_closed(spark, root, "dest", DEST_PROFILE, today=DAYS[2]) == DAYS[:1]
    assert seen(spark, root) == expected([b[:2] for b in batches] + [("w", 3)])
    # an uncommitted left-over and replaced folders go, readable ones stay
    write_batch(spark, root, "w", 9, DAYS[0], commit=False)
    assert commits.vacuum(spark, root, "dest", keep_seconds=3600) == 0
    assert commits.vacuum(spark, root, "dest", keep_seconds=-5) == 7
    assert seen(spark, root) == expected([b[:2] for b in batches] + [("w", 3)])
    assert sorted(r.day.isoformat() for r in commits.read_committed(spark, root, "dest", DEST_PROFILE, since=DAYS[1]).select("day").distinct().collect()) == DAYS[1:]


def test_a_reader_during_compactions_sees_every_row_once(spark, tmp_path):
    root = str(tmp_path)
    for batch in range(4):
        write_batch(spark, root, "w", batch, DAYS[0])
    want, wrong, done = expected([("w", b) for b in range(4)]), [], threading.Event()
    reads = []

    def read():
        while not done.is_set():
            got = seen(spark, root)
            reads.append(got)
            wrong.extend([got] if [r for r in got if r[0] == "w" and r[1] < 4] != want else [])

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for batch in range(4, 7):
            commits.compact(spark, root, "dest", DEST_PROFILE, DAYS[0])
            write_batch(spark, root, "w", batch, DAYS[0])
    finally:
        done.set()
        reader.join(120)
    assert not wrong and len(reads) > 1


def test_filters_on_the_day_prune_folders_and_the_schema_is_declared(spark, tmp_path):
    root = str(tmp_path)
    for batch, day in enumerate(DAYS):
        write_batch(spark, root, "w", batch, day)
    df = commits.read_committed(spark, root, "dest", DEST_PROFILE).filter(F.col("day") == DAYS[1])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and df.count() == 5
    declared = sources.read_history(spark, f"{root}/dest", DEST_PROFILE)
    assert declared.schema["destSumOfFlows"].dataType == DEST_PROFILE["destSumOfFlows"].dataType and declared.count() == 15


@pytest.fixture(scope="module")
def small_flows(spark):
    return flows_from_events(read_events(spark, SMALL))


def test_a_job_killed_between_two_tables_shows_nothing_and_repeats_once(spark, small_flows, tmp_path, monkeypatch):
    encode_flows(small_flows).write.text(str(tmp_path / "in"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    start = lambda: jobs.start_collection(sources.read_flow_stream(spark, "files", str(tmp_path / "in")), out, checkpoint, once=True)
    real = profiles.dest_profile
    monkeypatch.setattr(jobs.profiles, "dest_profile", lambda *a: 1 / 0)  # dies after the first table
    with pytest.raises(Exception):
        start().awaitTermination(300)
    assert spark.read.parquet(f"{out}/source").count() > 0
    assert commits.read_committed(spark, out, "source", SOURCE_PROFILE).count() == 0
    monkeypatch.setattr(jobs.profiles, "dest_profile", real)
    start().awaitTermination(300)
    assert commits.read_committed(spark, out, "source", SOURCE_PROFILE).count() == profiles.source_profile(small_flows, None).count()
    assert commits.read_committed(spark, out, "dest", DEST_PROFILE).count() == real(small_flows, None).count()


@pytest.mark.parametrize("kind", ["source", "dest"])
def test_a_finished_run_gives_its_open_windows(spark, flows, tmp_path, kind):  # noqa: F811
    build = {"source": profiles.source_profile, "dest": profiles.dest_profile}[kind]
    (low, middle), _, (_, high) = thirds(flows)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for begin, end in ((low, middle), (middle, high)):  # the second run closes what the first left open
        write_messages(flows, tmp_path / "in", begin, end)
        stream = stream_flows(spark, tmp_path / "in")
        jobs.start_profile_stream(stream, out, checkpoint, kind, DAY, "1 hour", once=True).awaitTermination(300)
        if end == high:  # before it is finished: no window twice
            stale = open_windows.read_profiles(spark, out)
            assert stale.count() == stale.select("windowStart", *[c for c in stale.columns if "Addr" in c or c == "vlanID"]).distinct().count()
        open_windows.finish_profiles(spark, out, checkpoint, kind)
        so_far = flows.filter(F.col("timestampStart") < end) if end < high else flows
        assert rows(open_windows.read_profiles(spark, out)) == rows(build(so_far, DAY))


def test_other_checkpoints_are_refused(spark, flows, tmp_path):  # noqa: F811
    (low, middle), _, _ = thirds(flows)
    write_messages(flows, tmp_path / "in", low, middle)
    jobs.start_profile_stream(stream_flows(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), "dest", DAY, "1 hour", True, once=True).awaitTermination(300)
    with pytest.raises(ValueError):
        open_windows.open_profiles(spark, str(tmp_path / "cp"), "dest")
