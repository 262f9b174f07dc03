"""Trees of all folds against one plain tree per fold."""

import numpy as np
import pytest

from tallyflow.operators import trees
from tallyflow.schemas import FEATURES

SCHEMA = "id long, " + ", ".join(f"{f} double" for f in FEATURES) + ", prediction long, fold long"


def table(seed, rows=180):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(rows, 5)), 1)  # many equal values
    y = 3 * (x[:, 0] > 0.2) + 4 * (x[:, 2] + 0.3 * rng.normal(size=rows) > 0) + 10
    return x, y, np.arange(rows) % 3


def frame(spark, x, y, fold):
    return spark.createDataFrame([(i, *map(float, v), int(y[i]), int(fold[i])) for i, v in enumerate(x)], SCHEMA)


def gini(y):
    return 1 - sum((y == c).mean() ** 2 for c in set(y.tolist())) if len(y) else 0.0


def plain(x, y, edges, depth, node=0):
    """The whole tree as {node: (feature, threshold, n, class)}; every edge of every feature is tried by its Gini impurity."""
    classes = sorted(set(y.tolist()))
    top = max(classes, key=lambda c: ((y == c).sum(), -c))
    options = []
    for f, name in enumerate(FEATURES):
        for cut in edges[name]:
            left = x[:, f] < cut
            if 0 < left.sum() < len(y):
                options.append((round((left.sum() * gini(y[left]) + (~left).sum() * gini(y[~left])) / len(y), 12), f, cut))
    best = min(options, default=None)
    if depth == 0 or best is None or best[0] >= gini(y) - 1e-9:
        return {node: (None, None, len(y), top)}
    left = x[:, best[1]] < best[2]
    return {node: (best[1], best[2], len(y), top)} | plain(x[left], y[left], edges, depth - 1, 2 * node + 1) | plain(x[~left], y[~left], edges, depth - 1, 2 * node + 2)


def walk(tree, v):
    node = 0
    while tree[node][0] is not None:
        node = 2 * node + 1 + int(v[tree[node][0]] >= tree[node][1])
    return tree[node][3]


@pytest.mark.parametrize("seed,kind", [(1, "values"), (2, "even"), (3, "quantile")])
def test_every_fold_has_its_exact_tree(spark, seed, kind):
    x, y, fold = table(seed)
    df = frame(spark, x, y, fold)
    if kind == "values":  # every value is an edge: the splits are those of exact Gini
        edges = {f: sorted(set(x[:, i].tolist())) for i, f in enumerate(FEATURES)}
    else:
        edges = (trees.even_edges if kind == "even" else trees.quantile_edges)(df, 16)
    nodes = trees.grow(df.repartition(5), edges, depth=4)
    got = {}
    for r in nodes.collect():
        got.setdefault(r.tree, {})[r.node] = (r.feature, r.threshold, r.n, r.prediction)
    want = {t: plain(x[fold != t], y[fold != t], edges, 4) for t in range(3)}
    assert got == want
    guesses = {r.id: r.guess for r in trees.tree_predictions(df, nodes).collect()}
    assert guesses == {i: walk(want[fold[i]], v) for i, v in enumerate(x)}


def test_odd_rows_and_empty_tables(spark):
    x, y, fold = table(4, 60)
    df = frame(spark, x, y, fold)
    odd = spark.createDataFrame([(900, None, 0.0, 0.0, 0.0, 0.0, 10, 0), (901, float("nan"), 0.0, 0.0, 0.0, 0.0, 10, 1), (902, 0.0, 0.0, 0.0, 0.0, 0.0, None, 1), (903, 0.0, 0.0, 0.0, 0.0, 0.0, 10, None)], SCHEMA)
    edges = trees.even_edges(df)
    nodes = trees.grow(df.union(odd), edges, depth=3)
    assert sorted(map(tuple, nodes.collect()), key=repr) == sorted(map(tuple, trees.grow(df, edges, depth=3).collect()), key=repr)
    guesses = {r.id: r.guess for r in trees.tree_predictions(df.union(odd), nodes).collect()}
    assert guesses[900] is None and guesses[901] is None and guesses[903] is None and guesses[902] is not None
    assert trees.grow(df.limit(0), edges).count() == 0
    one = trees.grow(df.filter("prediction = 10"), edges).collect()
    assert all(r.feature is None and r.prediction == 10 for r in one)
