"""Message decoding, validation and normalisation."""

import json

import pytest

from tallyflow.operators.flows import decode_flows, encode_flows, normalize_flows, pair_counts
from tallyflow.schemas import FLOW, MESSAGE_FIELDS

MESSAGE = {
    "SrcAddr": "10.0.0.1", "SrcPort": 1, "DstAddr": "10.0.0.2", "DstPort": 2, "SequenceNum": 3,
    "TCPFlags": 4, "Proto": 6, "TimeFlowStart": 100, "TimeFlowEnd": 101, "Bytes": 500,
    "Packets": 5, "VlanId": 100,
}


def messages(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) else json.dumps(v),) for v in values], "value string")


def test_valid_message_is_renamed_and_extra_fields_are_ignored(spark):
    valid, rejected = decode_flows(messages(spark, {**MESSAGE, "Other": {"x": 1}}))
    row = normalize_flows(valid).first()
    assert [f.name for f in FLOW.fields] == list(row.asDict())
    assert [row[name] for _, name, _ in MESSAGE_FIELDS] == list(MESSAGE.values())
    assert rejected.count() == 0


def test_missing_field_corrupt_text_and_wrong_type_are_rejected(spark):
    missing = {k: v for k, v in MESSAGE.items() if k != "Bytes"}
    wrong = {**MESSAGE, "Bytes": "many"}
    valid, rejected = decode_flows(messages(spark, MESSAGE, missing, "bad", wrong))
    assert valid.count() == 1
    assert {r.value for r in rejected.collect()} == {json.dumps(missing), "bad", json.dumps(wrong)}


def test_null_message_is_rejected(spark):
    frame = spark.createDataFrame([(None,)], "value string")
    valid, rejected = decode_flows(frame)
    assert valid.count() == 0 and rejected.count() == 1


def test_json_null_is_a_value(spark):
    valid, rejected = decode_flows(messages(spark, {**MESSAGE, "SrcAddr": None, "DstPort": None}))
    assert rejected.count() == 0
    assert normalize_flows(valid).first().srcAddr is None
    assert normalize_flows(valid, require="srcAddr").count() == 0


def test_strict_fails_on_a_bad_message(spark):
    valid, _ = decode_flows(messages(spark, MESSAGE, "bad"), strict=True)
    with pytest.raises(Exception, match="bad flow message"):
        valid.collect()


def test_strict_passes_good_messages(spark):
    valid, _ = decode_flows(messages(spark, MESSAGE, MESSAGE), strict=True)
    assert valid.count() == 2


def test_binary_value_as_a_broker_gives_it(spark):
    frame = messages(spark, MESSAGE).selectExpr("CAST(value AS BINARY) AS value")
    assert decode_flows(frame)[0].count() == 1


def test_encode_is_the_inverse(spark):
    valid, _ = decode_flows(messages(spark, MESSAGE, {**MESSAGE, "SrcAddr": None}))
    flows = normalize_flows(valid)
    again = normalize_flows(decode_flows(encode_flows(flows))[0])
    assert sorted(map(str, again.collect())) == sorted(map(str, flows.collect()))


def test_pair_counts(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 1)], "k string, v int")
    got = {(r.k, r.v): r.pairCount for r in pair_counts(frame, "k", "v").collect()}
    assert got == {("a", 1): 2, ("a", 2): 1, (None, 1): 1}
