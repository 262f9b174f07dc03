"""Machines, clusterings and curves that share passes, against plain forms of each."""

import numpy as np
import pytest

from tallyflow.operators import clustering, machines, tuning
from tallyflow.operators.neighbors import NeighborModel
from tallyflow.operators.voting import knn_predict
from tallyflow.schemas import FEATURES

SCHEMA = "id long, " + ", ".join(f"{f} double" for f in FEATURES) + ", prediction long, fold long"


def blobs(spark, rows=240, classes=3, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, 5)) * spread + np.repeat(rng.normal(scale=3, size=(classes, 5)), rows // classes, axis=0)
    label = np.repeat(np.arange(classes) * 10 + 5, rows // classes)
    data = [(i, *map(float, x[i]), int(label[i]), i % 4) for i in range(rows)]
    return x, label, spark.createDataFrame(data, SCHEMA)


def objective(z, sign, w):
    loss, slope = machines.rounded_hinge(1 - sign * (z @ w))
    n, counted = len(z), np.append(np.ones(z.shape[1] - 1), 0)
    return loss.sum() / n + 0.5 / n * (w * w * counted).sum(), -z.T @ (slope * sign) / n + w * counted / n


def plain_minimum(z, sign, steps=20_000):
    """Accelerated gradient descent for one machine alone."""
    w = v = np.zeros(z.shape[1])
    rate = 1.0 / (np.linalg.norm(z, 2) ** 2 / len(z) / machines.SMOOTH + 1)
    for i in range(steps):
        new = v - rate * objective(z, sign, v)[1]
        v = new + i / (i + 3) * (new - w)
        w = new
    return objective(z, sign, w)[0]


@pytest.mark.parametrize("wide", [32, 0])
def test_every_machine_reaches_its_own_minimum(spark, monkeypatch, wide):
    monkeypatch.setattr(machines, "WIDE", wide)  # 0: sums go through a second level of tasks
    x, label, df = blobs(spark, spread=2.5)
    waves = machines.fit_waves(df, 12, 0)
    points = df.selectExpr(*FEATURES, "CAST((prediction - 5) / 10 AS INT) AS label", "CAST(fold AS INT) AS fold").repartition(5)
    weights = machines.fit_machines(points, waves, np.array([60] * 4), 3, tol=1e-9, max_iter=300)
    z, fold = waves(x), np.arange(len(x)) % 4
    for f in range(4):
        for c in range(3):
            mine, sign = fold != f, np.where(label == c * 10 + 5, 1.0, -1.0)
            got = objective(z[mine], sign[mine], weights[:, f, c])[0]
            assert got <= plain_minimum(z[mine], sign[mine]) * (1 + 1e-3) + 1e-9


def test_passes_do_not_grow_with_machines_and_odd_rows_are_left_out(spark, monkeypatch):
    calls = []
    real = machines._sums
    monkeypatch.setattr(machines, "_sums", lambda *a: calls.append(1) or real(*a))
    _, _, df = blobs(spark)
    odd = spark.createDataFrame([(900, None, 1.0, 1.0, 1.0, 1.0, 5, 0), (901, float("nan"), 1.0, 1.0, 1.0, 1.0, 5, 1), (902, 1.0, 1.0, 1.0, 1.0, 1.0, None, 1)], SCHEMA)
    guessed = machines.cross_validated(df.union(odd), 30, 40, 1e-6)
    assert guessed.count() == 240 and len(calls) <= 41
    assert guessed.filter("guess = prediction").count() > 225
    assert machines.cross_validated(df.limit(0), 30, 5, 1e-6).count() == 0


def plain_lloyd(x, centers):
    near = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
    return np.array([x[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centers)]), near


def plain_silhouette(x, near):
    gap = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    out = []
    for i in range(len(x)):
        own = (near == near[i]).sum()
        inside = gap[i, near == near[i]].sum() / max(own - 1, 1)
        outside = min(gap[i, near == c].mean() for c in set(near) - {near[i]})
        out.append((outside - inside) / max(outside, inside) if own > 1 else 0.0)
    return np.mean(out)


@pytest.mark.parametrize("few", [32, 0])
def test_one_pass_moves_the_centres_of_every_k(spark, monkeypatch, few):
    monkeypatch.setattr(clustering, "FEW", few)
    x, _, df = blobs(spark, rows=90)
    centers = {k: x[::7][:k].copy() for k in (2, 3, 7)}
    centers[7][6] = 1e6  # no rows: it stays
    want = {k: plain_lloyd(x, c)[0] for k, c in centers.items()}
    got = clustering.lloyd_step(df.repartition(6), centers)
    assert all(np.allclose(got[k], want[k]) for k in centers) and got[7][6][0] == 1e6
    scores = {r.k: r.silhouette for r in clustering.silhouettes(df.repartition(6), centers).collect()}
    assert all(scores[k] == pytest.approx(plain_silhouette(x, plain_lloyd(x, c)[1])) for k, c in centers.items())


def test_equal_rows_in_a_row_are_placed_once(spark, monkeypatch):
    x, _, df = blobs(spark, rows=90)
    real = clustering._nearest

    def few(x, *where):
        assert len(x) <= 90, "every copy was placed"
        return real(x, *where)

    monkeypatch.setattr(clustering, "_nearest", few)
    thrice = df.coalesce(1).selectExpr("*", "explode(array(1, 2, 3)) AS vlan")  # as VLAN rows of a source
    x, centers = np.repeat(x, 3, axis=0), {k: x[::7][:k].copy() for k in (2, 5)}
    got = clustering.lloyd_step(thrice, centers)
    moments = {(r.k, r.prediction): r.n for r in clustering.cluster_moments(thrice, centers).collect()}
    scores = {r.k: r.silhouette for r in clustering.silhouettes(thrice, centers).collect()}
    for k, c in centers.items():
        want, near = plain_lloyd(x, c)
        assert np.allclose(got[k], want) and [moments[k, i] for i in range(k)] == np.bincount(near, minlength=k).tolist()
        assert scores[k] == pytest.approx(plain_silhouette(x, near))


def test_sweep_settles_every_k(spark):
    x, _, df = blobs(spark, rows=300, classes=5, spread=0.2)
    fitted = clustering.fit_sweep(df, [2, 5, 8], max_iter=50)
    assert all(np.allclose(plain_lloyd(x, c)[0], c, atol=1e-3) for c in fitted.values())
    assert clustering.best_k(clustering.sweep_k(df, [2, 3, 5, 8]), "silhouette").first().k == 5
    same = df.selectExpr("id", *[f"1.0D AS {f}" for f in FEATURES])
    assert {r.silhouette for r in clustering.sweep_k(same, [2, 3]).collect()} == {None}


@pytest.mark.parametrize("weights", ["distance", "uniform"])
def test_curve_winners_are_those_of_a_prediction_per_k(spark, weights):
    _, _, df = blobs(spark, rows=60, spread=4)
    tied = df.union(df.selectExpr("id + 100", *FEATURES, "prediction + 1", "fold")).filter("id % 5 > 0")  # equal rows of two classes
    model = NeighborModel.fit(tied, k=9, apart="fold")
    found = model.neighbors(tied, apart="fold")
    curve = {(r.id, r.k): r.Prediction for r in tuning.curve_predictions(found, [], weights=weights).collect()}
    assert len(curve) == 9 * tied.count()
    for k in (1, 2, 5, 9):
        for r in knn_predict(tied.drop("prediction"), model, k, weights, "fold").collect():
            assert curve[r.id, k] == r.Prediction


def test_rows_with_fewer_neighbours_do_not_count_for_larger_k(spark):
    _, _, df = blobs(spark, rows=6)
    curve = tuning.knn_holdout_curve(df.filter("id < 3"), df.filter("id >= 3"), range(1, 6)).collect()
    assert sorted(r.k for r in curve) == [1, 2, 3]


def test_curves_shuffle_no_rows(spark):
    _, _, df = blobs(spark)
    plan = tuning.knn_cv_curve(df, ks=[1, 2, 3])._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("ArrowEvalPython")]
    assert "Window" not in above and "hashpartitioning(id" not in above and "Sort" not in above
