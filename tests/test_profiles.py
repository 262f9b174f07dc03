"""Profiles on hand-made flows, and plan properties."""

import pytest
from pyspark.sql import functions as F

from tallyflow.operators import profiles
from tallyflow.schemas import DEST_MEASURES, SOURCE_MEASURES
from tallyflow.sources.stand_ins import flows_from_events, flows_from_lineitem, read_events
from tests.conftest import SMALL

COLUMNS = (
    "srcAddr string, srcPort long, dstAddr string, dstPort long, sampledFlow long, "
    "timestampStart long, numBytes long, numPackets long, vlanID long"
)


def flows(spark, *rows):
    return spark.createDataFrame(list(rows), COLUMNS)


def flow(src="a", sport=1, dst="x", dport=80, seq=1, start=10, size=100, packets=1, vlan=100):
    return (src, sport, dst, dport, seq, start, size, packets, vlan)


def source(df, **options):
    rows = profiles.source_profile(df, **options).collect()
    return sorted(((r.srcAddr, r.vlanID, *(r[m] for m in SOURCE_MEASURES)) for r in rows), key=repr)


def dest(df, **options):
    rows = profiles.dest_profile(df, **options).collect()
    return sorted(((r.dstAddr, *(r[m] for m in DEST_MEASURES)) for r in rows), key=repr)


def test_every_vlan_of_a_source_carries_its_totals(spark):
    df = flows(spark, flow(vlan=1), flow(vlan=2, seq=2), flow(vlan=2, seq=3, dst="y", dport=81))
    assert source(df, seconds=None) == [("a", 1, 3, 300, 3, 2, 2), ("a", 2, 3, 300, 3, 2, 2)]


def test_flows_are_distinct_sequence_numbers(spark):
    df = flows(spark, flow(seq=7), flow(seq=7), flow(seq=8))
    assert source(df, seconds=None) == [("a", 100, 2, 300, 3, 1, 1)]
    assert dest(df, seconds=None) == [("x", 2, 300, 3, 1, 1)]


def test_null_address_and_null_values_count(spark):
    df = flows(spark, flow(src=None, dport=None), flow(src=None, dport=80, vlan=None), flow(dst=None))
    assert source(df, seconds=None) == [
        ("a", 100, 1, 100, 1, 1, 1),
        (None, 100, 1, 200, 2, 1, 2),
        (None, None, 1, 200, 2, 1, 2),
    ]
    assert dest(df, seconds=None) == [("x", 1, 200, 2, 1, 1), (None, 1, 100, 1, 1, 1)]


def test_empty_address_is_kept(spark):
    assert source(flows(spark, flow(src="")), seconds=None) == [("", 100, 1, 100, 1, 1, 1)]


def test_windows_are_aligned_to_the_epoch(spark):
    df = flows(spark, flow(start=59), flow(start=60), flow(start=119), flow(start=-1))
    got = {(r.windowStart, r.sumOfBytes) for r in profiles.source_profile(df, 60).collect()}
    assert got == {(-60, 100), (0, 100), (60, 200)}


def test_bytes_beyond_32_bits(spark):
    df = flows(spark, flow(size=2**31), flow(size=2**31, seq=2))
    assert source(df, seconds=None)[0][3] == 2**32


def test_empty_input(spark):
    assert source(flows(spark), seconds=None) == [] and dest(flows(spark)) == []


def test_approximate_counts_are_close_and_sums_exact(spark):
    df = flows_from_lineitem(spark, SMALL)
    exact = {r[:2]: r[2:] for r in source(df, seconds=None)}
    near = {r[:2]: r[2:] for r in source(df, seconds=None, approx=True)}
    assert exact.keys() == near.keys()
    for key, want in exact.items():
        got = near[key]
        assert got[1:3] == want[1:3]
        for i in (0, 3, 4):
            assert abs(got[i] - want[i]) <= 0.25 * want[i] + 2


@pytest.mark.parametrize("partitions", [1, 7])
def test_partitioning_does_not_change_the_result(spark, partitions):
    df = flows_from_lineitem(spark, SMALL)
    assert source(df.repartition(partitions), seconds=None) == source(df, seconds=None)


def test_bytes_of_sources_equal_bytes_of_destinations(spark):
    df = flows_from_events(read_events(spark, SMALL))
    src = profiles.source_profile(df, 86400).dropDuplicates(["windowStart", "srcAddr"])
    dst = profiles.dest_profile(df, 86400)
    assert src.agg(F.sum("sumOfBytes")).first()[0] == dst.agg(F.sum("destSumOfBytes")).first()[0]


def test_single_measures_agree_with_the_profile(spark):
    df = flows_from_lineitem(spark, SMALL)
    profile = {(r.windowStart, r.srcAddr): r for r in profiles.source_profile(df, 7776000).collect()}
    singles = {
        "sumOfBytes": profiles.address_sum(df, "srcAddr", "numBytes", "m", 7776000),
        "uniqDstIPs": profiles.address_distinct(df, "srcAddr", "dstAddr", "m", 7776000),
        "sumOfFlows": profiles.address_distinct(df, "srcAddr", "sampledFlow", "m", 7776000),
    }
    for name, single in singles.items():
        for r in single.collect():
            assert profile[r.windowStart, r.srcAddr][name] == r.m


def test_distinct_values_are_spread_before_they_are_counted(spark):
    """The first shuffle is keyed by the counted value, not by the address alone."""
    df = flows_from_lineitem(spark, SMALL)
    plan = profiles.dest_profile(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" in plan and "collect_" not in plan
    scan = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert all("l_discount" not in line and "l_linestatus" not in line for line in scan)


@pytest.mark.parametrize("limits", [(1, 1), (1, 40), (4, 10)])
def test_busy_sources_are_counted_alike(spark, monkeypatch, limits):
    nulls = F.when(F.col("dstPort") != 7, F.col("dstPort"))
    df = flows_from_lineitem(spark, SMALL).withColumn("dstPort", nulls)
    df = df.withColumn("srcAddr", F.when(F.col("srcPort") % 3 > 0, F.col("srcAddr")))  # a third of all flows in one NULL source
    want = source(df, seconds=None)
    monkeypatch.setattr(profiles, "SAMPLED", limits[0])
    monkeypatch.setattr(profiles, "BUSY", limits[1])
    assert source(df, seconds=None) == want
    windows = profiles.source_profile(df, 7776000)
    again = profiles.source_profile(df.repartition(5), 7776000)
    assert windows.exceptAll(again).isEmpty() and again.exceptAll(windows).isEmpty()


def test_flows_of_sources_that_are_not_busy_are_shuffled_once(spark):
    profile = profiles.source_profile(flows_from_lineitem(spark, SMALL), 7776000)
    profile.collect()
    plan = profile._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Expand" not in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") <= 2  # the sample for busy sources, and the flows


@pytest.mark.parametrize("limits", [(1, 1), (1, 3), (1024, 64)])
def test_gathered_destinations_equal_those_by_grouping_sets(spark, monkeypatch, limits):
    monkeypatch.setattr(profiles, "SAMPLED", limits[0])
    monkeypatch.setattr(profiles, "BUSY", limits[1])
    df = flows_from_lineitem(spark, SMALL).withColumn("srcPort", F.when(F.col("srcPort") != 1030, F.col("srcPort")))
    df = df.withColumn("dstAddr", F.when(F.col("dstPort") % 3 > 0, F.col("dstAddr")))
    for seconds in (None, 7776000):
        want, got = (profiles.dest_profile(df, seconds, gather=g) for g in (False, True))
        assert want.schema.names == got.schema.names
        assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()
