"""Every registered query, as ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.functions.columns import epoch_date
from tallyflow.operators import (
    classifiers,
    clustering,
    features,
    moments,
    profiles,
    sketches,
    trees,
    tuning,
    verdict,
    voting,
)
from tallyflow.operators import flows as flow_ops
from tallyflow.operators.neighbors import NeighborModel
from tallyflow.plans.detection import detect, score
from tallyflow.plans.training import ModelBundle, train
from tallyflow.schemas import (
    ANOMALOUS,
    ANOMALY,
    COMPARE_FOLDS,
    COMPARE_SEED,
    FEATURES,
    HOLDOUT_KS,
    NEIGHBORS,
    SOURCE_PROFILE,
)
from tallyflow.session import materialize, new_table_path
from tallyflow.sinks.commits import compact_closed, read_committed
from tallyflow.sinks.tables import (
    BATCH_KEYS,
    append_batch,
    archive_rows,
    archived_flows,
    documents,
    read_batches,
    stamp,
    write_archive,
)
from tallyflow.sources.stand_ins import (
    BATCH_WIDTH,
    STREAM_WIDTH,
    flows_from_events,
    flows_from_lineitem,
    labelled_from_embeddings,
    read_events,
)
from tallyflow.sources.tables import read_flow_stream, read_history, read_table_stream
from tallyflow.streaming.jobs import start_collection, start_detection, start_profile_stream
from tallyflow.streaming.open_windows import finish_profiles, read_profiles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# ---- messages and flow records ----


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_ops.encode_flows(flows_from_events(read_events(spark, sf_dir)))


@query
def flow_decode(spark, sf_dir):
    valid, _ = flow_ops.decode_flows(_messages(spark, sf_dir))
    return valid


@query
def flow_normalize(spark, sf_dir):
    valid, _ = flow_ops.decode_flows(_messages(spark, sf_dir))
    return flow_ops.normalize_flows(valid)


@query
def flow_valid(spark, sf_dir):
    valid, _ = flow_ops.decode_flows(_messages(spark, sf_dir))
    return flow_ops.normalize_flows(valid, require="srcAddr")


@query
def flow_addressed(spark, sf_dir):
    """``flow_valid`` where a quarter of the messages have no source address: a JSON null, or an empty text, which counts as an address."""
    flows = flows_from_events(read_events(spark, sf_dir)).withColumn("turn", F.col("tcpFlags") % 8)
    text = flow_ops.encode_flows_keeping(flows, ["turn"])
    address = r'"SrcAddr":"[^"]*"'
    value = (
        F.when(F.col("turn") == 1, F.regexp_replace("value", address, '"SrcAddr":null'))
        .when(F.col("turn") == 5, F.regexp_replace("value", address, '"SrcAddr":""'))
        .otherwise(F.col("value"))
    )
    valid, _ = flow_ops.decode_flows(text.select(value.alias("value")))
    return flow_ops.normalize_flows(valid, require="srcAddr")


def _spoilt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event messages, a tenth of them broken: no field, no JSON, wrong type, JSON null."""
    events = read_events(spark, sf_dir)
    flows = flows_from_events(events).withColumn("turn", F.col("tcpFlags") % 40)
    text = flow_ops.encode_flows_keeping(flows, ["turn"])
    bytes_ = r'"Bytes":-?[0-9]+'
    turn = F.col("turn")
    value = (
        F.when(turn == 0, F.regexp_replace("value", bytes_ + ",", ""))
        .when(turn == 10, F.lit("bad"))
        .when(turn == 20, F.regexp_replace("value", bytes_, '"Bytes":"x"'))
        .when(turn == 30, F.regexp_replace("value", bytes_, '"Bytes":null'))
        .otherwise(F.col("value"))
    )
    return text.select(value.alias("value"))


def _collect(spark: SparkSession, messages: DataFrame, jobs: int) -> str:
    """Collection streams over the messages, each with its own checkpoint, into one folder."""
    path = new_table_path(spark, "collected")
    messages.write.text(f"{path}/in")
    for i in range(jobs):
        stream = read_flow_stream(spark, "files", f"{path}/in")
        start_collection(stream, f"{path}/out", f"{path}/checkpoint-{i}", once=True).awaitTermination()
    return f"{path}/out"


@query
def flow_rejected(spark, sf_dir):
    """What a collection stream puts aside, by what is wrong, and how much it keeps."""
    path = _collect(spark, _spoilt_messages(spark, sf_dir), 1)
    value = F.col("value")
    kind = (
        F.when(value == "bad", "text")
        .when(value.contains('"Bytes":"x"'), "type")
        .when(value.contains('"Bytes":null'), "null")
        .otherwise("missing")
    )
    bad = spark.read.parquet(f"{path}/rejected").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    kept = spark.read.parquet(f"{path}/dest").agg(F.sum("destSumOfPackets").alias("n"))
    return bad.union(kept.select(F.lit("packets kept").alias("kind"), "n"))


@query
def collected_history(spark, sf_dir):
    """Two collections into one folder: every profile row is there once for each."""
    path = _collect(spark, _messages(spark, sf_dir), 2)
    rows = read_batches(spark, f"{path}/source", SOURCE_PROFILE)
    return rows.groupBy(*SOURCE_PROFILE.fieldNames()).agg(F.count(F.lit(1)).alias("copies"))


@query
def compacted_history(spark, sf_dir):
    """As ``collected_history``, read by the commit records: a day compacted after the first collection, another batch after that."""
    path = new_table_path(spark, "compacted")
    messages = _messages(spark, sf_dir)
    messages.write.text(f"{path}/in")
    for i in range(2):
        stream = read_flow_stream(spark, "files", f"{path}/in")
        start_collection(stream, f"{path}/out", f"{path}/checkpoint-{i}", once=True).awaitTermination()
        if i == 0:
            compact_closed(spark, f"{path}/out", "source", SOURCE_PROFILE)
    rows = read_committed(spark, f"{path}/out", "source", SOURCE_PROFILE)
    return rows.groupBy(*SOURCE_PROFILE.fieldNames()).agg(F.count(F.lit(1)).alias("copies"))


@query
def flow_pair_counts(spark, sf_dir):
    return flow_ops.pair_counts(flows_from_lineitem(spark, sf_dir), "srcAddr", "dstAddr")


# ---- single measures ----


def _sum(name: str, key: str, measure: str, output: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: profiles.address_sum(
        flows_from_lineitem(spark, sf_dir), key, measure, output, BATCH_WIDTH
    )


def _distinct(name: str, key: str, counted: str, output: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: profiles.address_distinct(
        flows_from_lineitem(spark, sf_dir), key, counted, output, BATCH_WIDTH
    )


_sum("src_sum_bytes", "srcAddr", "numBytes", "sumOfBytes")
_sum("src_sum_packets", "srcAddr", "numPackets", "sumOfPackets")
_distinct("src_sum_flows", "srcAddr", "sampledFlow", "sumOfFlows")
_distinct("src_uniq_dst_ips", "srcAddr", "dstAddr", "uniqDstIPs")
_distinct("src_uniq_dst_ports", "srcAddr", "dstPort", "uniqDstPorts")
_sum("dst_sum_bytes", "dstAddr", "numBytes", "destSumOfBytes")
_sum("dst_sum_packets", "dstAddr", "numPackets", "destSumOfPackets")
_distinct("dst_sum_flows", "dstAddr", "sampledFlow", "destSumOfFlows")
_distinct("dst_uniq_src_ips", "dstAddr", "srcAddr", "uniqSrcIPs")
_distinct("dst_uniq_src_ports", "dstAddr", "srcPort", "uniqSrcPorts")


@query
def src_vlans(spark, sf_dir):
    return profiles.source_vlans(flows_from_lineitem(spark, sf_dir), BATCH_WIDTH)


# ---- profiles ----


@query
def source_profile(spark, sf_dir):
    return profiles.source_profile(flows_from_lineitem(spark, sf_dir), BATCH_WIDTH)


@query
def dest_profile(spark, sf_dir):
    return profiles.dest_profile(flows_from_lineitem(spark, sf_dir), BATCH_WIDTH, gather=True)


def _near(kind: str, exact: DataFrame, flows: DataFrame) -> DataFrame:
    """Exact profiles, and whether the counts merged from sketches of shorter windows lie within four deviations of them."""
    address, outputs = sketches.KINDS[kind]
    parts = sketches.sketch_profiles(flows, kind, BATCH_WIDTH // 90)
    merged = sketches.estimates(sketches.merge_profiles(parts, kind, BATCH_WIDTH), kind)
    guess = merged.select(*[F.col(c).alias(f"_{c}") for c in merged.columns])
    same = [exact[c].eqNullSafe(guess[f"_{c}"]) for c in ("windowStart", address)]
    within = [
        F.abs(F.col(n) - F.col(f"_{n}")) <= (0 if what in sketches.SUMS else F.greatest(F.lit(1.0), 4 * sketches.DEVIATION * F.col(n)))
        for n, what in outputs.items()
    ]
    return exact.join(guess, same, "left").select(*exact.columns, F.coalesce(reduce(and_, within), F.lit(False)).alias("near"))


@query
def source_profile_sketched(spark, sf_dir):
    return _near("source", source_profile(spark, sf_dir), flows_from_lineitem(spark, sf_dir))


@query
def dest_profile_sketched(spark, sf_dir):
    return _near("dest", dest_profile(spark, sf_dir), flows_from_lineitem(spark, sf_dir))


# ---- history, documents, archive ----


STAMPED_PROFILE = T.StructType([T.StructField("windowStart", T.LongType()), *SOURCE_PROFILE.fields, T.StructField("date", T.LongType())])


def _source_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line profiles written as one history batch and scanned back."""
    path = new_table_path(spark, "history")
    append_batch(stamp(source_profile(spark, sf_dir)), path, 0, "writer", "1998-01-01")
    return read_history(spark, path, STAMPED_PROFILE)


@query
def history_scan(spark, sf_dir):
    return _source_history(spark, sf_dir).drop("date", *BATCH_KEYS)


@query
def map_doc_unpack(spark, sf_dir):
    profile = source_profile(spark, sf_dir)
    entries = [part for f in FEATURES for part in (F.lit(f), F.col(f))]
    stored = profile.select(F.lit(None).cast("string").alias("_1"), F.create_map(*entries).alias("_2"))
    return features.unpack_documents(materialize(stored, "map-documents"))


@query
def profile_documents(spark, sf_dir):
    profile = source_profile(spark, sf_dir).drop("windowStart")
    return documents(profile, F.lit(1700000000000).cast("bigint"))


@query
def raw_flow_daily(spark, sf_dir):
    started = F.get_json_object("value", "$.TimeFlowStart").cast("bigint")
    dated = _messages(spark, sf_dir).withColumn("started", started)
    path = new_table_path(spark, "archive")
    write_archive(archive_rows(dated, day=epoch_date("started")), path)
    back = archived_flows(spark.read.parquet(path))
    return back.withColumn("ingestDate", F.date_format("ingestDate", "yyyy-MM-dd"))


# ---- features ----


def _line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = features.score_input(source_profile(spark, sf_dir))
    return features.feature_frame(profile, keep=["windowStart", "srcAddr", "vlanID"])


def _scaled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(_line_features(spark, sf_dir), "features")
    return features.scale(rows, features.fit_scaler(rows))


def _rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query
def score_input(spark, sf_dir):
    return features.score_input(source_profile(spark, sf_dir))


@query
def feature_cast(spark, sf_dir):
    rows = _line_features(spark, sf_dir)
    return rows.withColumns({f: F.col(f).cast("double") for f in FEATURES})


@query
def scaler_stats(spark, sf_dir):
    rows = _line_features(spark, sf_dir)
    return _rounded(features.scaler_stats(rows, features.fit_scaler(rows)), ["std"])


@query
def scaler_moments(spark, sf_dir):
    """``scaler_stats`` from moments kept per window: half of the windows first, then those that were new."""
    rows = materialize(source_profile(spark, sf_dir), "profiles")
    rows = features.score_input(rows)
    starts = sorted(str(r["windowStart"]) for r in rows.select("windowStart").distinct().collect())  # one per window
    path = new_table_path(spark, "moments")
    named = rows.withColumn("day", F.col("windowStart").cast("string"))
    read = lambda some: named.filter(F.col("windowStart").isin([int(d) for d in some]))
    for known in (starts[: len(starts) // 2], starts):
        kept, _ = moments.refresh(spark, path, dict.fromkeys(known, "whole"), read)
    return _rounded(moments.deviations(kept), ["std"])


@query
def scaled_features(spark, sf_dir):
    return _rounded(_scaled_lines(spark, sf_dir), FEATURES)


@query
def labelled_features(spark, sf_dir):
    rows = labelled_from_embeddings(spark, sf_dir)
    return _rounded(features.scale(rows, features.fit_scaler(rows)), FEATURES)


# ---- clustering ----

STEP_KS = range(2, 9)


@query
def cluster_sizes(spark, sf_dir):
    return clustering.cluster_sizes(labelled_from_embeddings(spark, sf_dir))


@query
def kmeans_centers(spark, sf_dir):
    return _rounded(clustering.cluster_means(labelled_from_embeddings(spark, sf_dir)), FEATURES)


@query
def kmeans_assign(spark, sf_dir):
    rows = labelled_from_embeddings(spark, sf_dir)
    means = clustering.cluster_means(rows).orderBy("prediction").collect()  # one row per cluster
    centers = [(m["prediction"], [m[f] for f in FEATURES]) for m in means]
    return clustering.assign(rows, centers).select("id", "prediction")


@query
def silhouette(spark, sf_dir):
    score = clustering.silhouette(labelled_from_embeddings(spark, sf_dir))
    return spark.createDataFrame([(round(score, 6),)], "silhouette double")


@query
def kmeans_fit(spark, sf_dir):
    scaled = _scaled_lines(spark, sf_dir)
    return clustering.model_centers(scaled, clustering.fit_kmeans(scaled))


@query
def kmeans_sweep(spark, sf_dir):
    return clustering.sweep_k(_scaled_lines(spark, sf_dir))


def _stepped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, clustering.Centers]:
    """Rows, and the centres of every k after three updates from the rows of the smallest ids."""
    rows = materialize(labelled_from_embeddings(spark, sf_dir), "labelled")
    first = rows.orderBy("id").limit(max(STEP_KS)).select(*FEATURES).collect()  # as many as centres
    centers = {k: np.array([list(r) for r in first[:k]]) for k in STEP_KS if k <= len(first)}
    for _ in range(3):
        centers = clustering.lloyd_step(rows, centers)
    return rows, centers


@query
def kmeans_step(spark, sf_dir):
    _, centers = _stepped(spark, sf_dir)
    return _rounded(clustering.center_rows(spark, centers), FEATURES)


@query
def kmeans_step_silhouettes(spark, sf_dir):
    return _rounded(clustering.silhouettes(*_stepped(spark, sf_dir)), ["silhouette"])


# ---- nearest neighbours: train rows answer for test rows ----

CLASSES = list(range(8))  # the labels the sign rule can give
LINE_ANOMALOUS = [c for c in ANOMALOUS if c in CLASSES]


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = tuning.holdout_split(labelled_from_embeddings(spark, sf_dir))
    train = rows.filter(F.col("part") == "train").drop("part")
    return train, rows.filter(F.col("part") == "test").drop("part")


def _model(spark: SparkSession, sf_dir: str, k: int = NEIGHBORS) -> tuple[NeighborModel, DataFrame]:
    train, test = _split(spark, sf_dir)
    return NeighborModel.fit(train, k=k), test


def _identified(test: DataFrame) -> DataFrame:
    """Give feature rows the identity columns of a profile."""
    return test.select(
        "id",
        F.concat(F.lit("10.0.0."), F.col("id") % 20).alias("srcAddr"),
        (F.lit(100) + F.col("id") % 3).alias("vlanID"),
        *FEATURES,
    )


def _class_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, test = _model(spark, sf_dir)
    rows = voting.knn_class_prob(_identified(test), model)
    return rows.select("id", "srcAddr", "vlanID", "Class", "Prob")


@query
def holdout_split(spark, sf_dir):
    return tuning.holdout_split(labelled_from_embeddings(spark, sf_dir)).select("id", "part")


@query
def knn_neighbors(spark, sf_dir):
    model, test = _model(spark, sf_dir)
    found = model.neighbors(test).select("id", F.posexplode("neighbors").alias("pos", "entry"))
    return found.select(
        "id",
        (F.col("pos") + 1).alias("rank"),
        F.col("entry.id").alias("neighborId"),
        F.col("entry.label").alias("neighborLabel"),
        F.round("entry.dist", 6).alias("dist"),
    )


@query
def knn_neighbors_cells(spark, sf_dir):
    """The distributed plan of ``knn_neighbors``, in small cells."""
    train, test = _split(spark, sf_dir)
    model = NeighborModel.fit(train, cell_rows=64, broadcast_rows=0)
    found = model.neighbors(test).select("id", F.posexplode("neighbors").alias("pos", "entry"))
    return found.select(
        "id",
        (F.col("pos") + 1).alias("rank"),
        F.col("entry.id").alias("neighborId"),
        F.col("entry.label").alias("neighborLabel"),
        F.round("entry.dist", 6).alias("dist"),
    )


@query
def knn_class_prob_cells(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    model = NeighborModel.fit(train, cell_rows=64, broadcast_rows=0)
    rows = voting.knn_class_prob(_identified(test), model)
    return _rounded(rows.select("id", "Class", "Prob"), ["Prob"])


@query
def knn_class_prob(spark, sf_dir):
    return _rounded(_class_prob(spark, sf_dir).select("id", "Class", "Prob"), ["Prob"])


@query
def knn_predict(spark, sf_dir):
    model, test = _model(spark, sf_dir)
    rows = voting.knn_predict(test.drop("prediction"), model)
    return _rounded(rows.select("id", "Prediction", "Probability"), ["Probability"])


@query
def knn_prob_wide(spark, sf_dir):
    wide = voting.prob_wide(_class_prob(spark, sf_dir), CLASSES)
    return _rounded(wide, [f"p{c}" for c in CLASSES])


@query
def knn_prob_array(spark, sf_dir):
    rows = voting.prob_array(_class_prob(spark, sf_dir), CLASSES)
    millionths = F.transform("probabilities", lambda p: F.round(p * 1000000).cast("bigint").cast("string"))
    return rows.select("id", F.array_join(millionths, ",").alias("millionths"))


@query
def knn_second_class_prob(spark, sf_dir):
    return _rounded(voting.second_class_prob(_class_prob(spark, sf_dir), CLASSES), ["probability"])


# ---- verdicts ----


@query
def anomaly_verdict(spark, sf_dir):
    return _rounded(verdict.verdict(_class_prob(spark, sf_dir), LINE_ANOMALOUS), ["Prob"])


@query
def anomaly_verdict_strict(spark, sf_dir):
    model, test = _model(spark, sf_dir)
    rows = voting.knn_predict(_identified(test), model)
    flagged = verdict.strict_verdict(rows, LINE_ANOMALOUS)
    return _rounded(flagged.select("id", "srcAddr", "vlanID", "Prediction", "Probability"), ["Probability"])


@query
def anomaly_pairs(spark, sf_dir):
    return verdict.anomaly_pairs(verdict.verdict(_class_prob(spark, sf_dir), LINE_ANOMALOUS))


@query
def mitigation_actions(spark, sf_dir):
    return verdict.mitigation_actions(anomaly_pairs(spark, sf_dir))


def _normal_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows deep inside the normal classes stand for normal-only traffic."""
    model, test = _model(spark, sf_dir)
    normal = test.filter((F.col("sumOfFlows") < -0.1) & ~F.col("prediction").isin(LINE_ANOMALOUS))
    return voting.knn_predict(normal.drop("prediction"), model)


@query
def normal_labels(spark, sf_dir):
    return verdict.normal_labels(_normal_predictions(spark, sf_dir))


@query
def anomalous_labels(spark, sf_dir):
    every = labelled_from_embeddings(spark, sf_dir).select(F.col("prediction").alias("label"))
    return verdict.anomalous_labels(every, normal_labels(spark, sf_dir))


def _profile_shares(spark: SparkSession, sf_dir: str, **limits: int) -> DataFrame:
    """Class shares of the odd windows' profiles, answered by the even windows'.

    Features stay unscaled whole numbers, so distances and their many ties are
    exact; the label is the band of the flow count.
    """
    number = (F.col("windowStart") / BATCH_WIDTH).cast("bigint")
    source = F.substring("srcAddr", 8, 20).cast("bigint")
    rows = materialize(_line_features(spark, sf_dir), "features").select(
        (number * 100000000 + source * 1000 + F.col("vlanID")).alias("id"),
        "windowStart",
        "srcAddr",
        "vlanID",
        *FEATURES,
        F.least(F.floor(F.col("sumOfFlows") / 8).cast("bigint"), F.lit(7)).alias("prediction"),
    )
    model = NeighborModel.fit(rows.filter(number % 2 == 0), **limits)
    return voting.knn_class_prob(rows.filter(number % 2 == 1).drop("prediction"), model)


@query
def profile_verdict(spark, sf_dir):
    flagged = verdict.verdict(_profile_shares(spark, sf_dir), LINE_ANOMALOUS)
    return _rounded(flagged.select("windowStart", "srcAddr", "vlanID", "Class", "Prob"), ["Prob"])


@query
def profile_verdict_cells(spark, sf_dir):
    """The distributed plan over the profiles, with crowded cells cut in blocks."""
    shares = _profile_shares(spark, sf_dir, cell_rows=1024, broadcast_rows=0, slot_rows=500, block_rows=600)
    flagged = verdict.verdict(shares, LINE_ANOMALOUS)
    return _rounded(flagged.select("windowStart", "srcAddr", "vlanID", "Class", "Prob"), ["Prob"])


# ---- tuning ----


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuning.stratified_folds(labelled_from_embeddings(spark, sf_dir))


@query
def stratified_folds(spark, sf_dir):
    return _folded(spark, sf_dir).select("id", "prediction", "fold")


@query
def knn_neighbors_apart_cells(spark, sf_dir):
    """Neighbours from other folds by the distributed plan, in small cells and smaller blocks."""
    rows = _folded(spark, sf_dir)
    model = NeighborModel.fit(rows, apart="fold", cell_rows=64, broadcast_rows=0, slot_rows=200, block_rows=24)
    found = model.neighbors(rows, apart="fold").select("id", F.posexplode("neighbors").alias("pos", "entry"))
    return found.select(
        "id", (F.col("pos") + 1).alias("rank"), F.col("entry.id").alias("neighborId"), F.round("entry.dist", 6).alias("dist")
    )


@query
def knn_cv_curve(spark, sf_dir):
    return _rounded(tuning.knn_cv_curve(_folded(spark, sf_dir)), ["accuracy"])


@query
def best_k(spark, sf_dir):
    return clustering.best_k(knn_cv_curve(spark, sf_dir), "accuracy")


def _holdout_curve(spark: SparkSession, sf_dir: str, ks=HOLDOUT_KS) -> DataFrame:
    return _rounded(tuning.knn_holdout_curve(*_split(spark, sf_dir), ks), ["error", "accuracy"])


@query
def knn_error_curve(spark, sf_dir):
    return _holdout_curve(spark, sf_dir).select("k", "error")


@query
def knn_accuracy_curve(spark, sf_dir):
    return _holdout_curve(spark, sf_dir).select("k", "accuracy")


@query
def knn_holdout_accuracy(spark, sf_dir):
    return _holdout_curve(spark, sf_dir, [NEIGHBORS]).select("k", "accuracy")


# ---- classifier comparison ----


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuning.shuffled_folds(labelled_from_embeddings(spark, sf_dir), COMPARE_FOLDS, COMPARE_SEED)


def _classifier(name: str) -> None:
    run = classifiers.CLASSIFIERS[name]
    QUERIES[f"clf_{name.lower()}"] = lambda spark, sf_dir: _rounded(run(_compared(spark, sf_dir)), ["accuracy"])


for _name in classifiers.CLASSIFIERS:
    _classifier(_name)


def _trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = materialize(_compared(spark, sf_dir), "compared")
    return rows, trees.grow(rows, trees.even_edges(rows), depth=3)


@query
def tree_nodes(spark, sf_dir):
    """The trees of all folds as a table; leaves have feature -1."""
    _, nodes = _trees(spark, sf_dir)
    return _rounded(nodes.fillna(-1, "feature").fillna(0.0, "threshold"), ["threshold"])


@query
def tree_predictions(spark, sf_dir):
    return trees.tree_predictions(*_trees(spark, sf_dir)).select("id", "fold", "guess")


@query
def model_summary(spark, sf_dir):
    """The comparison for the classifiers that SQL can fit too."""
    models = {name: classifiers.CLASSIFIERS[name] for name in ("KNN", "LDA", "NB")}
    scores = classifiers.compare_classifiers(labelled_from_embeddings(spark, sf_dir), models)
    return _rounded(tuning.score_summary(scores), ["mean", "std"])


@query
def fold_spread(spark, sf_dir):
    scores = classifiers.nearest_neighbors(_compared(spark, sf_dir))
    return _rounded(tuning.fold_spread(scores), ["low", "q1", "median", "q3", "high"])


@query
def model_comparison(spark, sf_dir):
    rows = labelled_from_embeddings(spark, sf_dir)
    return tuning.score_summary(classifiers.compare_classifiers(rows))


# ---- streams ----


@query
def stream_source_profile(spark, sf_dir):
    """Event flows as a file stream; the windows that the watermark closed."""
    flows = flows_from_events(read_table_stream(spark, sf_dir, "events"))
    path = new_table_path(spark, "stream")
    run = start_profile_stream(
        flows, f"{path}/out", f"{path}/checkpoint", seconds=STREAM_WIDTH, delay="1 hour", once=True
    )
    run.awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query
def stream_source_profile_whole(spark, sf_dir):
    """All windows of a finished run: those the watermark closed, and those read from its state."""
    flows = flows_from_events(read_table_stream(spark, sf_dir, "events"))
    path = new_table_path(spark, "stream")
    out, checkpoint = f"{path}/out", f"{path}/checkpoint"
    start_profile_stream(flows, out, checkpoint, seconds=STREAM_WIDTH, delay="1 hour", once=True).awaitTermination()
    finish_profiles(spark, out, checkpoint)
    return read_profiles(spark, out)


# ---- flagship: history to models to flagged sources ----


@query
def detect_anomalies(spark, sf_dir):
    """Train on even windows, take sources up to the third quartile as normal, flag sources of odd windows."""
    profile = materialize(source_profile(spark, sf_dir), "profiles")
    number = F.col("windowStart") / BATCH_WIDTH
    history = features.score_input(profile).filter(number % 2 == 0)
    ordinary = history.approxQuantile("sumOfBytes", [0.75], 0.001)[0]
    normal = history.filter(F.col("sumOfBytes") <= ordinary)
    bundle = train(history, normal, ["windowStart", "srcAddr", "vlanID"])
    return detect(profile.filter(number % 2 == 1), bundle)


STREAMED = 107  # number of the (odd) window whose messages are streamed
QUIET = 24  # flows in a window up to which the stand-in for normal traffic goes


def _stored_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ModelBundle]:
    """Profiles, and a model that was saved and loaded: even windows labelled by the band of their flow count,
    scaled, and the labels that their quiet rows are given taken as normal."""
    profile = materialize(source_profile(spark, sf_dir), "profiles")
    number = (F.col("windowStart") / BATCH_WIDTH).cast("bigint")
    id = number * 100000000 + F.substring("srcAddr", 8, 20).cast("bigint") * 1000 + F.col("vlanID")
    history = features.score_input(profile).filter(number % 2 == 0)
    band = F.least(F.floor(F.col("sumOfFlows") / 8).cast("bigint"), F.lit(7))
    rows = history.select(id.alias("id"), band.alias("prediction"), *[F.col(f).cast("float").alias(f) for f in FEATURES])
    rows = materialize(rows, "features")
    scaler = features.fit_scaler(rows)
    scaled = features.scale(rows, scaler)
    model = NeighborModel.fit(scaled)
    quiet = features.scale(rows.filter(F.col("sumOfFlows") <= QUIET).drop("prediction"), scaler)
    met = verdict.normal_labels(voting.knn_predict(quiet, model)).withColumn("is_normal", F.lit(True))
    labels = model.rows.select("label").distinct().join(met, "label", "left").fillna(False, "is_normal")
    path = new_table_path(spark, "model")
    ModelBundle(scaler, model, labels).save(path)
    return profile.filter(number % 2 == 1), ModelBundle.load(spark, path)


@query
def stored_model_scores(spark, sf_dir):
    profile, bundle = _stored_model(spark, sf_dir)
    return _rounded(score(profile, bundle, ["windowStart", "srcAddr", "vlanID"]), ["Prob"])


@query
def stored_model_pairs(spark, sf_dir):
    """The flagship's path from stored model to flagged pairs, with labels that SQL can give too."""
    profile, bundle = _stored_model(spark, sf_dir)
    return detect(profile, bundle)


@query
def detected_stream_pairs(spark, sf_dir):
    """What a detection stream commits for the messages of one window, scored with the stored model."""
    _, bundle = _stored_model(spark, sf_dir)
    flows = flows_from_lineitem(spark, sf_dir)
    start = F.col("timestampStart") - F.pmod("timestampStart", F.lit(BATCH_WIDTH))
    path = new_table_path(spark, "detected")
    flow_ops.encode_flows(flows.filter(start == STREAMED * BATCH_WIDTH)).write.text(f"{path}/in")
    messages = read_flow_stream(spark, "files", f"{path}/in")
    start_detection(messages, bundle, f"{path}/out", f"{path}/checkpoint", once=True).awaitTermination()
    found = read_committed(spark, f"{path}/out", "anomalies", ANOMALY)
    return found.select("srcAddr", "vlanID")
