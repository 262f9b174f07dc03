"""Scaling, clustering, voting, tuning, verdicts and classifiers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyflow.operators import classifiers, clustering, features, tuning, verdict, voting
from tallyflow.operators.neighbors import NeighborModel
from tallyflow.schemas import FEATURES
from tallyflow.sources.stand_ins import labelled_from_embeddings
from tests.conftest import SMALL


def frame(spark, rows):
    """Rows of (id, prediction, first feature); the other features are zero."""
    data = [(i, p, float(x), 0.0, 0.0, 0.0, 0.0) for i, p, x in rows]
    return spark.createDataFrame(data, ["id", "prediction", *FEATURES])


def shares(spark, reference, query, k, weights="distance"):
    model = NeighborModel.fit(frame(spark, reference), k=k)
    rows = voting.knn_class_prob(frame(spark, query).drop("prediction"), model, k, weights).collect()
    return {(r.id, r.Class): round(r.Prob, 9) for r in rows}


# ---- features ----


def test_float_cast_loses_what_a_32_bit_float_loses(spark):
    df = spark.createDataFrame([(16777217, 1, 1, 1, 1)], FEATURES)
    assert features.feature_frame(df).first().sumOfBytes == 16777216.0


def test_constant_feature_scales_to_zero_and_others_to_unit_deviation(spark):
    df = frame(spark, [(i, 0, i * 3.7) for i in range(20)])
    scaled = features.scale(df, features.fit_scaler(df))
    stats = scaled.agg(F.stddev_samp("sumOfBytes").alias("s"), F.max("sumOfFlows").alias("z")).first()
    assert stats.s == pytest.approx(1.0) and stats.z == 0.0
    assert scaled.filter("id = 2").first().sumOfBytes == pytest.approx(7.4 / np.std([i * 3.7 for i in range(20)], ddof=1))


def test_rows_without_source_are_not_scored(spark):
    df = spark.createDataFrame([("",), (None,), ("a",)], "srcAddr string")
    assert [r.srcAddr for r in features.score_input(df).collect()] == ["a"]


def test_row_id_depends_on_the_key_only(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("srcAddr"), (F.col("id") % 4).alias("vlanID"))
    ids = lambda d: {(r.srcAddr, r.vlanID): r.id for r in d.withColumn("id", features.row_id("srcAddr", "vlanID")).collect()}
    assert ids(df) == ids(df.repartition(13)) and len(set(ids(df).values())) == 100


# ---- voting ----


def test_equal_row_takes_all_the_weight(spark):
    got = shares(spark, [(1, 5, 1.0), (2, 6, 2.0), (3, 6, 2.5)], [(9, 0, 1.0)], 3)
    assert got == {(9, 5): 1.0}


def test_several_equal_rows_vote_one_each(spark):
    got = shares(spark, [(1, 5, 1.0), (2, 6, 1.0), (3, 6, 1.0), (4, 7, 9.0)], [(9, 0, 1.0)], 4)
    assert got == {(9, 5): round(1 / 3, 9), (9, 6): round(2 / 3, 9)}


def test_distance_and_uniform_weights(spark):
    reference = [(1, 5, 1.0), (2, 6, 2.0)]
    assert shares(spark, reference, [(9, 0, 0.0)], 2) == {(9, 5): round(2 / 3, 9), (9, 6): round(1 / 3, 9)}
    assert shares(spark, reference, [(9, 0, 0.0)], 2, "uniform") == {(9, 5): 0.5, (9, 6): 0.5}


def test_tie_goes_to_the_smaller_label(spark):
    model = NeighborModel.fit(frame(spark, [(1, 6, 1.0), (2, 5, -1.0)]), k=2)
    row = voting.knn_predict(frame(spark, [(9, 0, 0.0)]).drop("prediction"), model, 2).first()
    assert row.Prediction == 5 and row.Probability == 0.5


def test_probabilities_sum_to_one_and_forms_agree(spark):
    df = labelled_from_embeddings(spark, SMALL)
    model = NeighborModel.fit(df.filter("id % 2 = 0"), k=36)
    queries = df.filter("id % 2 = 1").drop("prediction")
    prob = voting.knn_class_prob(queries, model).select("id", "Class", "Prob")
    for r in prob.groupBy("id").agg(F.sum("Prob").alias("total")).collect():
        assert r.total == pytest.approx(1.0)
    long = {(r.id, r.Class): r.Prob for r in prob.collect()}
    arrays = {r.id: r.probabilities for r in voting.prob_array(prob, list(range(8))).collect()}
    second = {r.id: r.probability for r in voting.second_class_prob(prob, list(range(8))).collect()}
    for i, values in arrays.items():
        assert values == [long.get((i, c), 0.0) for c in range(8)] and second[i] == values[1]


# ---- verdicts ----


def probabilities(spark, rows):
    return spark.createDataFrame(rows, "srcAddr string, vlanID long, Class long, Prob double")


def test_any_share_of_an_anomalous_class_flags(spark):
    prob = probabilities(spark, [("a", 1, 0, 0.97), ("a", 1, 2, 0.03), ("b", 1, 0, 1.0), ("c", 1, 2, 0.0)])
    assert [r.srcAddr for r in verdict.verdict(prob, [2, 3]).collect()] == ["a"]
    table = spark.createDataFrame([(2,), (3,)], "label int")
    assert [r.srcAddr for r in verdict.verdict(prob, table).collect()] == ["a"]
    assert verdict.verdict(prob, [2, 3], min_prob=0.5).count() == 0


def test_label_table_is_joined(spark):
    prob = probabilities(spark, [("a", 1, 2, 0.5), ("b", 1, 0, 1.0)])
    table = spark.createDataFrame([(2,), (3,)], "label int")
    assert [r.srcAddr for r in verdict.verdict(prob, table).collect()] == ["a"]
    df = spark.createDataFrame([("sure", 0, 1.0), ("bad", 2, 1.0)], "srcAddr string, Prediction long, Probability double")
    assert [r.srcAddr for r in verdict.strict_verdict(df, table).collect()] == ["bad"]


def test_search_runs_once_per_row_and_needs_no_class_shuffle(spark):
    df = labelled_from_embeddings(spark, SMALL)
    model = NeighborModel.fit(df, k=5)
    prob = voting.knn_class_prob(df.drop("prediction"), model, 5)
    flagged = verdict.verdict(prob, spark.createDataFrame([(2,)], "label long"))
    strict = verdict.strict_verdict(voting.knn_predict(df.drop("prediction"), model, 5), [2])
    for frame_ in (flagged, strict):
        plan = frame_._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_two_anomalous_classes_give_one_pair(spark):
    prob = probabilities(spark, [("a", 1, 2, 0.5), ("a", 1, 3, 0.5), ("a", 2, 3, 1.0)])
    pairs = verdict.anomaly_pairs(verdict.verdict(prob, [2, 3]))
    assert sorted((r.srcAddr, r.vlanID) for r in pairs.collect()) == [("a", 1), ("a", 2)]
    actions = sorted(r.action for r in verdict.mitigation_actions(pairs).collect())
    assert actions == ['{"srcAddr":"a","vlanID":1}', '{"srcAddr":"a","vlanID":2}']


def test_strict_rule(spark):
    rows = [("sure", 0, 1.0), ("unsure", 0, 0.97), ("bad", 2, 1.0)]
    df = spark.createDataFrame(rows, "srcAddr string, Prediction long, Probability double")
    table = spark.createDataFrame([(2,)], "label long")
    for labels in ([2], table):
        got = {r.srcAddr for r in verdict.strict_verdict(df, labels).collect()}
        assert got == {"unsure", "bad"}


def test_remaining_labels_are_anomalous(spark):
    labels = spark.createDataFrame([(i % 4,) for i in range(8)], "label long")
    predicted = spark.createDataFrame([(0,), (0,), (3,)], "Prediction long")
    rest = verdict.anomalous_labels(labels, verdict.normal_labels(predicted))
    assert sorted(r.label for r in rest.collect()) == [1, 2]


# ---- tuning ----


def test_split_and_folds_do_not_depend_on_partitions(spark):
    df = spark.range(2000)
    split = lambda d: sorted(map(tuple, tuning.holdout_split(d).collect()))
    assert split(df) == split(df.repartition(11))
    train = sum(part == "train" for _, part in split(df))
    assert 1400 < train < 1600
    assert tuning.holdout_split(df, seed=1).filter("part = 'train'").count() != train
    folds = tuning.shuffled_folds(df, 10, 7).groupBy("fold").count().collect()
    assert len(folds) == 10 and all(140 < r["count"] < 260 for r in folds)


@pytest.mark.parametrize("slices", [1, 5, 64])
def test_stratified_folds_equal_plain_ranking(spark, slices):
    df = labelled_from_embeddings(spark, SMALL).select("id", "prediction")
    got = {r.id: r.fold for r in tuning.stratified_folds(df, slices=slices).collect()}
    seen, want = {}, {}
    for r in sorted(df.collect(), key=lambda r: r.id):
        want[r.id] = seen.get(r.prediction, 0) % 10
        seen[r.prediction] = seen.get(r.prediction, 0) + 1
    assert got == want


def test_one_pass_curve_equals_a_fit_per_fold_and_k(spark):
    df = tuning.stratified_folds(labelled_from_embeddings(spark, SMALL), folds=3)
    curve = {r.k: r.accuracy for r in tuning.knn_cv_curve(df, ks=[1, 4, 9]).collect()}
    rows = df.orderBy("id").collect()
    x = np.array([[r[f] for f in FEATURES] for r in rows])
    y = np.array([r.prediction for r in rows])
    fold = np.array([r.fold for r in rows])
    for k, got in curve.items():
        means = []
        for f in range(3):
            train = fold != f
            right = []
            for v, truth in zip(x[~train], y[~train]):
                dist = np.sqrt(((x[train] - v) ** 2).sum(axis=1))
                near = np.argsort(dist, kind="stable")[:k]
                votes = {}
                for n in near:
                    votes[y[train][n]] = votes.get(y[train][n], 0) + 1 / dist[n]
                right.append(min(votes, key=lambda c: (-votes[c], c)) == truth)
            means.append(np.mean(right))
        assert got == pytest.approx(np.mean(means))


def test_error_is_one_minus_accuracy(spark):
    df = tuning.holdout_split(labelled_from_embeddings(spark, SMALL))
    curve = tuning.knn_holdout_curve(df.filter("part = 'train'"), df.filter("part = 'test'"), range(1, 6)).collect()
    assert sorted(r.k for r in curve) == [1, 2, 3, 4, 5]
    assert all(r.error == pytest.approx(1 - r.accuracy) for r in curve)


def test_best_k_takes_the_smallest_on_ties(spark):
    curve = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9)], "k int, s double")
    assert clustering.best_k(curve, "s").first().k == 2
    assert clustering.best_k(curve, "s", largest=False).first().k == 1


# ---- clustering ----


def test_kmeans_finds_separated_groups_and_sweep_prefers_them(spark):
    rows = [(i, 0, (i % 3) * 100 + i * 0.01) for i in range(90)]
    df = frame(spark, rows).drop("prediction")
    model = clustering.fit_kmeans(df, 3)
    labelled = clustering.label(df, model)
    assert sorted(r["count"] for r in clustering.cluster_sizes(labelled).collect()) == [30, 30, 30]
    assert clustering.silhouette(labelled) > 0.99
    sweep = clustering.sweep_k(df, [2, 3, 4])
    assert sweep.count() == 3
    assert clustering.best_k(sweep, "silhouette").first().k == 3
    centers = [(r.prediction, [r[f] for f in FEATURES]) for r in clustering.model_centers(df, model).collect()]
    same = clustering.assign(df, centers).join(labelled.select("id", F.col("prediction").alias("p")), "id")
    assert same.filter("p <> prediction").count() == 0


# ---- classifiers ----


def test_linear_discriminant_matches_numpy(spark):
    df = tuning.shuffled_folds(labelled_from_embeddings(spark, SMALL), 3, 7)
    got = {r.fold: r.accuracy for r in classifiers.linear_discriminant(df).collect()}
    rows = df.collect()
    x = np.array([[r[f] for f in FEATURES] for r in rows])
    y, fold = np.array([r.prediction for r in rows]), np.array([r.fold for r in rows])
    for f in range(3):
        tx, ty = x[fold != f], y[fold != f]
        labels = np.unique(ty)
        means = np.array([tx[ty == c].mean(axis=0) for c in labels])
        within = sum((tx[ty == c] - m).T @ (tx[ty == c] - m) for c, m in zip(labels, means))
        inverse = np.linalg.inv(within / (len(tx) - len(labels)))
        prior = np.log([np.mean(ty == c) for c in labels])
        score = x[fold == f] @ inverse @ means.T - 0.5 * np.einsum("ij,jk,ik->i", means, inverse, means) + prior
        assert got[f] == pytest.approx(np.mean(labels[score.argmax(axis=1)] == y[fold == f]))


@pytest.mark.parametrize("name", ["LR", "CART", "NB", "KNN", "LDA"])
def test_classifiers_learn_separated_groups(spark, name):
    rows = [(i, i % 2, (i % 2) * 50 + (i * 7 % 11)) for i in range(80)]
    df = tuning.shuffled_folds(frame(spark, rows), 2, 7)
    scores = classifiers.CLASSIFIERS[name](df).collect()
    assert sorted(r.fold for r in scores) == [0, 1]
    assert all(r.model == name and r.accuracy > 0.95 for r in scores)


def test_kernel_features_approximate_the_kernel(spark):
    df = labelled_from_embeddings(spark, SMALL).limit(20)
    x = np.array([[r[f] for f in FEATURES] for r in df.orderBy("id").collect()])
    waves = classifiers.kernel_features(df, count=4000).orderBy("id").collect()
    phi = np.array([r.features.toArray() for r in waves])
    gamma = 1 / (5 * x.var())
    want = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(phi @ phi.T - want).max() < 0.15


def test_support_vectors_and_summary(spark):
    rows = [(i, i % 2, (i % 2) * 50 + (i * 7 % 11)) for i in range(60)]
    scores = classifiers.compare_classifiers(
        frame(spark, rows),
        {"SVM": lambda d: classifiers.support_vectors(d, max_iter=5, kernel_count=20), "KNN": classifiers.nearest_neighbors},
        folds=2,
    )
    summary = {r.model: r for r in tuning.score_summary(scores).collect()}
    assert summary["KNN"].mean == 1.0 and summary["KNN"].std == 0.0 and summary["SVM"].mean > 0.9
    spread = tuning.fold_spread(scores).filter("model = 'KNN'").first()
    assert (spread.low, spread.median, spread.high) == (1.0, 1.0, 1.0)
