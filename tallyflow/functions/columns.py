"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPACE = 1 << 32


def window_start(seconds: int, epoch: str = "timestampStart") -> Column:
    """Start of the tumbling window, in epoch seconds, that holds ``epoch``."""
    t = F.col(epoch)
    return t - F.pmod(t, F.lit(seconds))


def hash32(seed: int, key: Column) -> Column:
    """32 bits of a seeded hash that any SQL engine with md5 can reproduce."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def feature_cast(name: str) -> Column:
    """Feature as a 32-bit float, the precision the models are trained in."""
    return F.col(name).cast("float")


def epoch_date(epoch: str) -> Column:
    """Calendar day (UTC) of an epoch-second column, whatever the session zone."""
    days = F.floor(F.col(epoch) / F.lit(86400)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def squared_distance(features: list[str], center: list[float]) -> Column:
    total = None
    for name, value in zip(features, center):
        gap = F.col(name) - F.lit(float(value))
        total = gap * gap if total is None else total + gap * gap
    return total
