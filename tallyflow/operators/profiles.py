"""Per-window traffic profiles of sources and destinations.

Each profile is two chained aggregations over one scan. The first groups by
GROUPING SETS, one set per thing to be counted distinctly, so the shuffle key
holds the counted value and the traffic of a single busy address spreads over
all tasks. The second only adds up what is left per address, after a map-side
combine. The same plan runs on a stream, where every distinct value is one small
state row and no address owns an ever-growing set.

In batch, sources that are not busy in their window take a shorter way: their few
values are gathered as sets in one aggregation, so a flow is shuffled once and not
once per counted column. A sample finds the busy ones; it decides only which way a
source goes, and both ways count exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.columns import window_start
from tallyflow.schemas import BATCH_SECONDS


def with_window(flows: DataFrame, seconds: int | None = BATCH_SECONDS) -> tuple[DataFrame, list[str]]:
    """Add the window key. ``None``: the whole frame is one window (a micro-batch)."""
    if seconds is None:
        return flows, []
    if flows.isStreaming:
        return flows.withColumn("window", F.window("eventTime", f"{seconds} seconds")), ["window"]
    return flows.withColumn("windowStart", window_start(seconds)), ["windowStart"]


def _name_window(profile: DataFrame) -> DataFrame:
    """Give the window of a streamed profile the batch name and type."""
    if "window" not in profile.columns:
        return profile
    rest = [c for c in profile.columns if c != "window"]
    return profile.select(F.unix_timestamp(F.col("window.start")).alias("windowStart"), *rest)


def _distinct_values(flows: DataFrame, by: list[str], counted: list[str]) -> DataFrame:
    """One row per (window, address, counted column, value), with its traffic."""
    sets = [[F.col(c) for c in [*by, name]] for name in counted]
    return flows.groupingSets(sets, *[F.col(c) for c in by + counted]).agg(
        F.grouping_id().alias("grouping"),
        F.sum("numBytes").alias("bytes"),
        F.sum("numPackets").alias("packets"),
    )


def _in_set(counted: list[str], name: str) -> Column:
    """Rows of the grouping set of ``name``: the only counted column not rolled up."""
    others = sum(1 << (len(counted) - 1 - i) for i, c in enumerate(counted) if c != name)
    return F.col("grouping") == others


def _measures(counted: list[str], names: dict[str, str]) -> list[Column]:
    """Distinct counts per counted column, and the sums, read off one grouping set."""
    first = _in_set(counted, counted[-1])
    outputs = []
    for output, what in names.items():
        if what in ("bytes", "packets"):
            outputs.append(F.sum(F.when(first, F.col(what))).alias(output))
        else:
            outputs.append(F.count(F.when(_in_set(counted, what), F.lit(1))).alias(output))
    return outputs


def _approximate_distinct(name: str) -> Column:
    """About how many values a column has; NULL counts as one."""
    return F.approx_count_distinct(name) + F.max(F.col(name).isNull().cast("bigint"))


def _approximate(names: dict[str, str]) -> list[Column]:
    sums = {"bytes": "numBytes", "packets": "numPackets"}
    return [
        F.sum(sums[what]).alias(output) if what in sums else _approximate_distinct(what).alias(output)
        for output, what in names.items()
    ]


def _null_free(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str], list[Column]]:
    """Add each key as a value that is never NULL plus a NULL mark; returns also the way back.

    Plain equality then joins NULL keys too, on columns the aggregation is already
    partitioned by, so the totals are not shuffled again for the join.
    """
    kinds = dict(df.dtypes)
    columns, back = {}, []
    for c in by:
        stand_in = F.lit("" if kinds[c] == "string" else 0).cast(kinds[c])
        columns[f"_{c}"] = F.coalesce(F.col(c), stand_in)
        columns[f"_no_{c}"] = F.col(c).isNull()
        back.append(F.when(~F.col(f"_no_{c}"), F.col(f"_{c}")).alias(c))
    return df.withColumns(columns), list(columns), back


SOURCE_COUNTED = ["sampledFlow", "dstAddr", "dstPort", "vlanID"]
SAMPLED = 1024  # one of so many flows, told by a hash of what is counted, is looked at for busy sources
BUSY = 64  # flows in that sample from which on a source is busy in its window
DEST_COUNTED = ["sampledFlow", "srcAddr", "srcPort"]
SOURCE_FROM = {
    "sumOfFlows": "sampledFlow",
    "sumOfBytes": "bytes",
    "sumOfPackets": "packets",
    "uniqDstIPs": "dstAddr",
    "uniqDstPorts": "dstPort",
}
DEST_FROM = {
    "destSumOfFlows": "sampledFlow",
    "destSumOfBytes": "bytes",
    "destSumOfPackets": "packets",
    "uniqSrcIPs": "srcAddr",
    "uniqSrcPorts": "srcPort",
}


def source_profile(
    flows: DataFrame, seconds: int | None = BATCH_SECONDS, approx: bool = False
) -> DataFrame:
    """Six measures per source; one row per VLAN of the source, each with whole-source totals.

    ``sumOfFlows`` counts distinct sequence numbers; NULL counts as a value. VLANs
    are gathered per source; the list is bounded by the VLAN id space (12 bits).
    """
    flows, window = with_window(flows, seconds)
    by = window + ["srcAddr"]
    if approx:
        totals = flows.groupBy(*by).agg(F.collect_set(F.struct("vlanID")).alias("vlans"), *_approximate(SOURCE_FROM))
        return _source_rows(totals, by)
    if flows.isStreaming:
        return source_of_values(_distinct_values(flows, by, SOURCE_COUNTED), by)
    flows, keys, back = _null_free(flows, by)
    busy = F.broadcast(_busy(flows, keys, SOURCE_COUNTED))  # AQE drops the second branch if there is none
    vlans = F.collect_set(F.struct("vlanID")).alias("vlans")
    few = _source_rows(flows.join(busy, keys, "left_anti").groupBy(*keys).agg(vlans, *_gathered(SOURCE_FROM)), keys)
    many = source_of_values(_distinct_values(flows.join(busy, keys, "left_semi"), keys, SOURCE_COUNTED), keys)
    return few.unionByName(many).select(*back[:-1], "vlanID", back[-1], *SOURCE_FROM)


def _busy(flows: DataFrame, keys: list[str], counted: list[str]) -> DataFrame:
    """Addresses with about ``SAMPLED * BUSY`` different flows or more in a window: at most one row for so many flows."""
    drawn = F.pmod(F.xxhash64(*counted), F.lit(SAMPLED)) == 0
    numbers = flows.filter(drawn).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return numbers.filter(F.col("n") >= BUSY).select(*keys)


def _gathered(names: dict[str, str]) -> list[Column]:
    """Measures of addresses that are not busy, from sets of their values, in one shuffle."""
    sums = {"bytes": "numBytes", "packets": "numPackets"}
    return [
        F.sum(sums[what]).alias(output) if what in sums else _few_distinct(what).alias(output)
        for output, what in names.items()
    ]


def _few_distinct(name: str) -> Column:
    """How many values a column has; NULL counts as one. For few values: they are gathered."""
    return F.size(F.collect_set(name)) + F.max(F.col(name).isNull().cast("bigint"))


def source_of_values(values: DataFrame, by: list[str]) -> DataFrame:
    """Source profiles from the values counted in a stream: the second aggregation."""
    mine = F.when(_in_set(SOURCE_COUNTED, "vlanID"), F.struct("vlanID"))
    totals = values.groupBy(*by).agg(F.collect_list(mine).alias("vlans"), *_measures(SOURCE_COUNTED, SOURCE_FROM))
    return _source_rows(totals, by)


def _source_rows(totals: DataFrame, by: list[str]) -> DataFrame:
    rows = totals.select(*by, F.explode("vlans").alias("vlan"), *SOURCE_FROM)
    return _name_window(rows.select(*by[:-1], "vlan.vlanID", by[-1], *SOURCE_FROM))


def dest_profile(
    flows: DataFrame, seconds: int | None = BATCH_SECONDS, approx: bool = False, gather: bool = False
) -> DataFrame:
    """Five measures per destination. ``gather``: those that are not busy take the shorter way of ``source_profile``."""
    flows, window = with_window(flows, seconds)
    by = window + ["dstAddr"]
    if approx:
        return _name_window(flows.groupBy(*by).agg(*_approximate(DEST_FROM)))
    if gather and not flows.isStreaming:
        flows, keys, back = _null_free(flows, by)
        busy = F.broadcast(_busy(flows, keys, DEST_COUNTED))
        few = flows.join(busy, keys, "left_anti").groupBy(*keys).agg(*_gathered(DEST_FROM))
        many = dest_of_values(_distinct_values(flows.join(busy, keys, "left_semi"), keys, DEST_COUNTED), keys)
        return few.unionByName(many).select(*back, *DEST_FROM)
    return dest_of_values(_distinct_values(flows, by, DEST_COUNTED), by)


def dest_of_values(values: DataFrame, by: list[str]) -> DataFrame:
    return _name_window(values.groupBy(*by).agg(*_measures(DEST_COUNTED, DEST_FROM)))


def address_sum(flows: DataFrame, key: str, measure: str, name: str, seconds: int | None = BATCH_SECONDS) -> DataFrame:
    """One summed measure per address and window."""
    flows, window = with_window(flows, seconds)
    return _name_window(flows.groupBy(*window, key).agg(F.sum(measure).alias(name)))


def address_distinct(
    flows: DataFrame, key: str, counted: str, name: str, seconds: int | None = BATCH_SECONDS, approx: bool = False
) -> DataFrame:
    """One distinct count per address and window; NULL counts as a value."""
    flows, window = with_window(flows, seconds)
    if approx:
        return _name_window(flows.groupBy(*window, key).agg(_approximate_distinct(counted).alias(name)))
    pairs = flows.groupBy(*window, key, counted).agg(F.count(F.lit(1)).alias("pairCount"))
    return _name_window(pairs.groupBy(*window, key).agg(F.count(F.lit(1)).alias(name)))


def source_vlans(flows: DataFrame, seconds: int | None = BATCH_SECONDS) -> DataFrame:
    """Distinct (source, VLAN) pairs per window."""
    flows, window = with_window(flows, seconds)
    return flows.select(*window, "srcAddr", "vlanID").distinct()
