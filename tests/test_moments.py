"""Merged moments against whole fits, and sketches against exact counts."""

import pytest
from pyspark.sql import functions as F

from tallyflow.operators import features, moments, profiles, sketches
from tallyflow.schemas import FEATURES
from tallyflow.session import materialize
from tallyflow.sources.stand_ins import flows_from_lineitem
from tests.conftest import SMALL

SCHEMA = "day string, " + ", ".join(f"{f} double" for f in FEATURES)


def days(spark, sizes):
    rows = [(f"d{d}", 1e8 + i * 3 + d, float(i % 7 + 100 * d), 5.0, float(i), float(d)) for d, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def stds(df):
    return {r["feature"]: r["std"] for r in df.collect()}


def test_merged_moments_equal_a_whole_fit(spark):
    df = days(spark, [1, 40, 3, 200])
    got = stds(moments.deviations(moments.feature_moments(df, ["day"])))
    cast = features.feature_frame(df)
    whole = dict(zip(FEATURES, map(float, features.fit_scaler(cast).std)))
    assert got == {f: pytest.approx(whole[f], rel=1e-9) for f in FEATURES}
    again = moments.feature_moments(df, ["day"]).repartition(7)  # whatever the order of the parts
    assert stds(moments.deviations(again)) == {f: pytest.approx(got[f], rel=1e-12) for f in FEATURES}
    scaled = moments.scale_by(cast, moments.deviations(again))
    want = features.scale(cast, features.fit_scaler(cast))
    for f in FEATURES:
        assert scaled.agg(F.sum(f)).first()[0] == pytest.approx(want.agg(F.sum(f)).first()[0], rel=1e-9)


def test_refresh_reads_only_new_and_changed_days(spark, tmp_path):
    df, path, read = days(spark, [20, 30, 10]), str(tmp_path / "moments"), []

    def read_days(names):
        read.append(names)
        return df.filter(F.col("day").isin(names))

    kept, stale = moments.refresh(spark, path, {"d0": "a", "d1": "a"}, read_days)
    assert stale == ["d0", "d1"]
    kept, stale = moments.refresh(spark, path, {"d0": "a", "d1": "a", "d2": "a"}, read_days)
    assert stale == ["d2"] and read == [["d0", "d1"], ["d2"]]
    want = stds(moments.deviations(moments.feature_moments(df, [])))
    assert stds(moments.deviations(kept)) == {f: pytest.approx(want[f]) for f in FEATURES}
    df = df.union(df.filter("day = 'd1'").withColumn("sumOfFlows", F.lit(9999.0)))  # a late batch
    kept, stale = moments.refresh(spark, path, {"d0": "a", "d1": "b", "d2": "a"}, read_days)
    assert stale == ["d1"]
    want = stds(moments.deviations(moments.feature_moments(df, [])))
    assert stds(moments.deviations(kept)) == {f: pytest.approx(want[f]) for f in FEATURES}
    assert moments.refresh(spark, path, {"d0": "a"}, read_days)[1] == [] and len(read) == 3
    gone, _ = moments.refresh(spark, path, {"d0": "a"}, read_days)
    assert {r["day"] for r in gone.select("day").distinct().collect()} == {"d0"}


def test_missing_values_and_single_rows(spark):
    df = spark.createDataFrame([("a", None, 1.0, 2.0, 3.0, 4.0), ("b", 5.0, 1.0, None, 3.0, 4.0), ("c", None, None, None, None, None)], SCHEMA)
    got = stds(moments.deviations(moments.feature_moments(df, ["day"])))
    assert got == {"sumOfBytes": 0.0, "sumOfFlows": 0.0, "sumOfPackets": 0.0, "uniqDstIPs": 0.0, "uniqDstPorts": 0.0}
    assert moments.deviations(moments.feature_moments(df.limit(0), ["day"])).count() == 0


@pytest.mark.parametrize("kind,address,exact", [("source", "srcAddr", profiles.source_profile), ("dest", "dstAddr", profiles.dest_profile)])
def test_merged_sketches_equal_sketches_of_the_whole_and_lie_near_the_counts(spark, kind, address, exact):
    flows = flows_from_lineitem(spark, SMALL).withColumn("dstPort", F.when(F.col("dstPort") > 2, F.col("dstPort")))
    flows = flows.unionByName(flows.limit(50).withColumn(address, F.lit(None).cast("string")))
    day, span = 86_400, 30 * 86_400
    parts = materialize(sketches.sketch_profiles(flows, kind, day), "sketches")
    merged = sketches.estimates(sketches.merge_profiles(parts, kind, span), kind)
    whole = sketches.estimates(sketches.sketch_profiles(flows, kind, span), kind)
    counts = exact(flows, span).drop("vlanID").distinct()
    names = list(sketches.KINDS[kind][1])
    by = lambda df: {(r["windowStart"], r[address]): [r[n] for n in names] for r in df.collect()}
    one, two, true = by(merged), by(whole), by(counts)
    assert set(one) == set(two) == set(true)
    for key, values in true.items():
        for name, a, b, c in zip(names, one[key], two[key], values):
            limit = 0 if sketches.KINDS[kind][1][name] in sketches.SUMS else max(1, 4 * sketches.DEVIATION * c)
            assert abs(a - c) <= limit and abs(b - c) <= limit


def test_estimates_of_large_counts_keep_the_bound(spark):
    flows = spark.range(60_000).selectExpr("'a' AS srcAddr", "id AS sampledFlow", "CAST(id % 20000 AS STRING) AS dstAddr", "id % 7 AS dstPort", "1 AS numBytes", "1 AS numPackets", "id AS timestampStart")
    parts = sketches.sketch_profiles(flows, "source", 600)
    row = sketches.estimates(sketches.merge_profiles(parts, "source", 60_000), "source").first()
    assert row.sumOfBytes == 60_000 and row.uniqDstPorts == 7
    assert abs(row.sumOfFlows - 60_000) <= 4 * sketches.DEVIATION * 60_000 and abs(row.uniqDstIPs - 20_000) <= 4 * sketches.DEVIATION * 20_000
