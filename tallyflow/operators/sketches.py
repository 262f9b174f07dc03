"""Profiles with stored, mergeable sketches of their distinct counts.

The profiles of short windows keep sketches instead of counts; those of hours and days are unions of
them, so nothing is counted again and no flow is read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.operators.profiles import DEST_FROM, SOURCE_FROM, with_window
from tallyflow.schemas import BATCH_SECONDS

SIZE = 12  # log2 of a sketch's registers
DEVIATION = 1.04 / (1 << SIZE // 2)  # relative standard deviation of an estimate
KINDS = {"source": ("srcAddr", SOURCE_FROM), "dest": ("dstAddr", DEST_FROM)}
SUMS = {"bytes": "numBytes", "packets": "numPackets"}


def _sketched(name: str) -> Column:
    """NULL counts as a value, so it goes in as a text that no value has."""
    return F.hll_sketch_agg(F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("")), SIZE)


def sketch_profiles(flows: DataFrame, kind: str = "source", seconds: int = BATCH_SECONDS) -> DataFrame:
    """Per window and address: sums, and a sketch for every distinct count. One scan, combined before the shuffle."""
    address, outputs = KINDS[kind]
    flows, window = with_window(flows, seconds)
    made = [(F.sum(SUMS[what]) if what in SUMS else _sketched(what)).alias(name) for name, what in outputs.items()]
    return flows.groupBy(*window, address).agg(*made)


def merge_profiles(profiles: DataFrame, kind: str, seconds: int) -> DataFrame:
    """Sketched profiles of longer windows, whose length is a multiple of that of the stored ones."""
    address, outputs = KINDS[kind]
    start = F.col("windowStart") - F.pmod(F.col("windowStart"), F.lit(seconds))
    made = [(F.sum(name) if what in SUMS else F.hll_union_agg(name)).alias(name) for name, what in outputs.items()]
    return profiles.groupBy(start.alias("windowStart"), address).agg(*made)


def estimates(profiles: DataFrame, kind: str) -> DataFrame:
    """Sketched profiles with counts in place of sketches."""
    _, outputs = KINDS[kind]
    return profiles.withColumns({name: F.hll_sketch_estimate(name) for name, what in outputs.items() if what not in SUMS})
