"""Decode, validate and normalise flow messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.schemas import FLOW_MESSAGE, MESSAGE_FIELDS

_CORRUPT = "_corrupt"
_PARSE = T.StructType(FLOW_MESSAGE.fields + [T.StructField(_CORRUPT, T.StringType())])
_NAMES = [raw for raw, _, _ in MESSAGE_FIELDS]
_MEASURED = ["Bytes", "Packets", "TimeFlowStart"]  # cannot be summed or put in a window if NULL


def _is_valid(message: Column, value: Column) -> Column:
    """All twelve fields are there and well typed.

    A JSON null counts as there, except in what is summed or timed. The key list is
    parsed only for messages with a null field.
    """
    filled = reduce(lambda a, b: a & b, [message[n].isNotNull() for n in _NAMES])
    required = F.array(*[F.lit(n) for n in _NAMES])
    present = F.size(F.array_except(required, F.json_object_keys(value))) == 0
    measured = reduce(lambda a, b: a & b, [message[n].isNotNull() for n in _MEASURED])
    return message[_CORRUPT].isNull() & measured & (filled | F.coalesce(present, F.lit(False)))


def parse_flows(df: DataFrame, value: str = "value", strict: bool = False) -> DataFrame:
    """Messages parsed once: ``value`` (text), ``message`` (struct) and whether it is ``ok``.

    With ``strict`` a bad message fails the job, as a missing field does in the
    original pipeline.
    """
    text = F.col(value).cast("string")
    message = F.from_json(text, _PARSE, {"columnNameOfCorruptRecord": _CORRUPT})
    # a filter is pushed into a projection and would parse again there, but not into an explode
    parsed = df.select(text.alias("value"), F.explode(F.array(message)).alias("message"))
    ok = F.coalesce(_is_valid(F.col("message"), F.col("value")), F.lit(False))
    if strict:
        reason = F.concat(F.lit("bad flow message: "), F.coalesce(F.col("value"), F.lit("null")))
        ok = F.when(ok, F.lit(True)).otherwise(F.raise_error(reason).cast("boolean"))
    return parsed.withColumn("ok", ok)


def decode_flows(
    df: DataFrame, value: str = "value", strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Parse JSON messages into ``(valid, rejected)``.

    ``valid`` has the message fields as columns, ``rejected`` the message text.
    """
    return split_parsed(parse_flows(df, value, strict))


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)`` of parsed messages."""
    valid = parsed.filter("ok").select(*[F.col("message")[n].alias(n) for n in _NAMES])
    return valid, parsed.filter("not ok").select("value")


def normalize_flows(messages: DataFrame, require: str | None = None) -> DataFrame:
    """Twelve named fields; ``require`` optionally keeps rows with that address."""
    flows = messages.select(*[F.col(raw).alias(name) for raw, name, _ in MESSAGE_FIELDS])
    return flows if require is None else flows.filter(F.col(require).isNotNull())


def encode_flows(flows: DataFrame) -> DataFrame:
    """Inverse of decode + normalise: one JSON message per flow record."""
    return encode_flows_keeping(flows, [])


def encode_flows_keeping(flows: DataFrame, keep: list[str]) -> DataFrame:
    """``encode_flows`` with further columns of the flows beside the message."""
    fields = [F.col(name).alias(raw) for raw, name, _ in MESSAGE_FIELDS]
    return flows.select(*keep, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def pair_counts(flows: DataFrame, key: str, value: str, by: list[str] | None = None) -> DataFrame:
    """How often each ``(key, value)`` pair occurs."""
    return flows.groupBy(*(by or []), key, value).agg(F.count(F.lit(1)).alias("pairCount"))
