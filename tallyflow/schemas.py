"""Declared schemas and fixed values of the flow pipeline."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: message fields and the names they take in a flow record ----
MESSAGE_FIELDS = [
    ("SrcAddr", "srcAddr", T.StringType()),
    ("SrcPort", "srcPort", T.LongType()),
    ("DstAddr", "dstAddr", T.StringType()),
    ("DstPort", "dstPort", T.LongType()),
    ("SequenceNum", "sampledFlow", T.LongType()),
    ("TCPFlags", "tcpFlags", T.LongType()),
    ("Proto", "protocol", T.LongType()),
    ("TimeFlowStart", "timestampStart", T.LongType()),
    ("TimeFlowEnd", "timestampEnd", T.LongType()),
    ("Bytes", "numBytes", T.LongType()),
    ("Packets", "numPackets", T.LongType()),
    ("VlanId", "vlanID", T.LongType()),
]

# ---- fixed values: model features in model order ----
FEATURES = ["sumOfBytes", "sumOfFlows", "sumOfPackets", "uniqDstIPs", "uniqDstPorts"]

# ---- fixed values: published label sets of the 14-cluster model ----
NORMAL = [0, 1, 5, 13, 8, 10, 11, 4, 12]
ANOMALOUS = [2, 3, 6, 7, 9]

# ---- fixed values: published settings ----
BATCH_SECONDS = 60
CLUSTERS = 14
SWEEP_KS = range(2, 20)
KMEANS_SEED = 1
NEIGHBORS = 36
CV_KS = range(1, 41)
CV_FOLDS = 10
HOLDOUT_KS = range(1, 40)
COMPARE_FOLDS = 10
COMPARE_SEED = 7
CERTAIN = 0.99

FLOW_MESSAGE = T.StructType([T.StructField(raw, t) for raw, _, t in MESSAGE_FIELDS])
FLOW = T.StructType([T.StructField(name, t) for _, name, t in MESSAGE_FIELDS])

SOURCE_MEASURES = ["sumOfFlows", "sumOfBytes", "sumOfPackets", "uniqDstIPs", "uniqDstPorts"]
DEST_MEASURES = ["destSumOfFlows", "destSumOfBytes", "destSumOfPackets", "uniqSrcIPs", "uniqSrcPorts"]

SOURCE_PROFILE = T.StructType(
    [T.StructField("vlanID", T.LongType()), T.StructField("srcAddr", T.StringType())]
    + [T.StructField(m, T.LongType()) for m in SOURCE_MEASURES]
)
DEST_PROFILE = T.StructType(
    [T.StructField("dstAddr", T.StringType())]
    + [T.StructField(m, T.LongType()) for m in DEST_MEASURES]
)
FEATURE_FRAME = T.StructType(
    [T.StructField("id", T.LongType())] + [T.StructField(f, T.DoubleType()) for f in FEATURES]
)
LABELLED = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("prediction", T.LongType())]
    + [T.StructField(f, T.DoubleType()) for f in FEATURES]
)
CLASS_PROB = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("Class", T.LongType()),
        T.StructField("Prob", T.DoubleType()),
    ]
)
ANOMALY = T.StructType(
    [T.StructField("srcAddr", T.StringType()), T.StructField("vlanID", T.LongType())]
)
