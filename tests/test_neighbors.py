"""The neighbour join against brute force, for both the broadcast and the cell plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyflow.functions.cells import Index, Rows, build_cells
from tallyflow.operators import voting
from tallyflow.operators.neighbors import NeighborModel, unusable
from tallyflow.schemas import FEATURES


def _frame(spark, x, label=None, fold=None):
    rows = [
        (i, *map(float, v), int(0 if label is None else label[i]), int(0 if fold is None else fold[i]))
        for i, v in enumerate(x)
    ]
    return spark.createDataFrame(rows, ["id", *FEATURES, "prediction", "fold"])


def _brute(x, ref, k, apart=None):
    answers = []
    for i, v in enumerate(x):
        dist = np.sqrt(sum((v[j] - ref[:, j]) ** 2 for j in range(ref.shape[1])))
        pairs = [
            (float(d), int(r))
            for r, d in enumerate(dist)
            if apart is None or apart[0][i] != apart[1][r]
        ]
        answers.append(sorted(pairs)[:k])
    return answers


def _got(df):
    return {r.id: [(n.dist, n.id) for n in r.neighbors] for r in df.collect()}


def _data(seed, n, kind):
    rng = np.random.default_rng(seed)
    if kind == "normal":
        return rng.normal(size=(n, 5))
    if kind == "grid":  # many equal distances and equal vectors
        return rng.integers(0, 3, size=(n, 5)).astype(float)
    x = rng.lognormal(0, 2, size=(n, 5))  # heavy tail, and a third of all rows equal
    x[: n // 3] = x[0]
    return x


LIMITS = [{}, {"broadcast_rows": 0, "slot_rows": 50}, {"broadcast_rows": 0, "slot_rows": 30, "block_rows": 13}]
NAMES = ["broadcast", "cells", "blocks"]


@pytest.mark.parametrize("limits", LIMITS, ids=NAMES)
@pytest.mark.parametrize("kind", ["normal", "grid", "heavy"])
def test_equals_brute_force(spark, kind, limits):
    ref, x = _data(1, 900, kind), _data(2, 300, kind)
    model = NeighborModel.fit(_frame(spark, ref), k=12, cell_rows=40, **limits)
    assert model.cells.depth >= 2
    got = _got(model.neighbors(_frame(spark, x)))
    want = _brute(x, ref, 12)
    assert got == {i: w for i, w in enumerate(want)}


@pytest.mark.parametrize("limits", LIMITS, ids=NAMES)
def test_skips_own_group(spark, limits):
    x = _data(3, 400, "heavy")
    fold = np.arange(400) % 10
    frame = _frame(spark, x, fold=fold)
    model = NeighborModel.fit(frame, k=7, apart="fold", cell_rows=60, **limits)
    got = _got(model.neighbors(frame, apart="fold"))
    want = _brute(x, x, 7, (fold, fold))
    assert got == {i: w for i, w in enumerate(want)}


@pytest.mark.parametrize("limits", LIMITS, ids=NAMES)
def test_fewer_rows_than_k_and_missing_feature(spark, limits):
    ref = _data(4, 5, "normal")
    model = NeighborModel.fit(_frame(spark, ref), k=12, cell_rows=2, **limits)
    queries = _frame(spark, _data(5, 3, "normal")).withColumn(
        "sumOfFlows", F.when(F.col("id") == 2, F.lit(None).cast("double")).otherwise(F.col("sumOfFlows"))
    )
    got = _got(model.neighbors(queries))
    want = _brute(_data(5, 3, "normal"), ref, 12)
    assert got[0] == want[0] and got[1] == want[1] and got[2] == []


def test_save_and_load(spark, tmp_path):
    ref, x = _data(6, 500, "normal"), _data(7, 50, "normal")
    model = NeighborModel.fit(_frame(spark, ref), k=9, cell_rows=40)
    model.save(str(tmp_path / "model"))
    loaded = NeighborModel.load(spark, str(tmp_path / "model"))
    assert loaded.k == 9
    queries = _frame(spark, x)
    assert _got(loaded.neighbors(queries)) == _got(model.neighbors(queries))


def test_too_large_k_is_refused(spark):
    model = NeighborModel.fit(_frame(spark, _data(8, 20, "normal")), k=3)
    with pytest.raises(ValueError):
        model.neighbors(_frame(spark, _data(8, 20, "normal")), k=4)


@pytest.mark.parametrize("kind", ["normal", "grid", "heavy"])
@pytest.mark.parametrize("leaf", [8, 64, 4096])
def test_index_in_a_task(kind, leaf):
    ref, x = _data(9, 700, kind), _data(10, 120, kind)
    rng = np.random.default_rng(11)
    ids = rng.permutation(700)
    group, own = rng.integers(0, 4, 700), rng.integers(0, 4, 120)
    index = Index.build(Rows(ref, ids, ids % 3, group), leaf)
    query, row, dist = index.search(x, own, 10)
    got = [[] for _ in x]
    for q, r, d in zip(query, row, dist):
        got[q].append((float(d), int(index.rows.id[r])))
    for i, v in enumerate(x):
        d = np.sqrt(sum((v[j] - ref[:, j]) ** 2 for j in range(5)))
        assert got[i] == sorted((float(d[r]), int(ids[r])) for r in range(700) if group[r] != own[i])[:10]


def test_rows_without_finite_features_are_left_out(spark):
    rows = [(i, i % 3, float(i), float(i % 7), 0.0, 1.0, float(i % 5)) for i in range(300)]
    bad = [(900, 1, None, 0.0, 0.0, 0.0, 0.0), (901, 1, float("nan"), 0.0, 0.0, 0.0, 0.0), (902, 1, float("inf"), 0.0, 0.0, 0.0, 0.0)]
    schema = "id bigint, prediction bigint, " + ", ".join(f"{f} double" for f in FEATURES)
    clean, dirty = spark.createDataFrame(rows, schema), spark.createDataFrame(rows + bad, schema)
    queries = clean.select("id", *FEATURES).filter("id % 10 = 0")
    found = lambda frame, **limits: sorted(
        (r["id"], [n["id"] for n in r["neighbors"]]) for r in NeighborModel.fit(frame, k=5, **limits).neighbors(queries).collect()
    )
    want = found(clean)
    assert found(dirty) == want == found(dirty, cell_rows=16, broadcast_rows=0)
    assert unusable(dirty) == 3


@pytest.mark.parametrize("limits", LIMITS[1:], ids=NAMES[1:])
def test_cells_full_of_the_own_group(spark, limits):
    x = np.sort(_data(12, 400, "normal"), axis=0)  # groups lie together, so a cell holds little that a row may meet
    fold = np.arange(400) // 100
    frame = _frame(spark, x, fold=fold)
    model = NeighborModel.fit(frame, k=9, apart="fold", cell_rows=20, **limits)
    assert _got(model.neighbors(frame, apart="fold")) == dict(enumerate(_brute(x, x, 9, (fold, fold))))


def test_reach_is_finite_and_holds_the_neighbours():
    rng = np.random.default_rng(13)
    ref, x = _data(13, 300, "normal"), _data(14, 80, "heavy")
    group = rng.integers(0, 3, 300)
    cells = build_cells(ref, 4)
    cell = cells.assign(ref)
    used = np.unique(cell)
    low, high = (np.array([f(ref[cell == c], axis=0) for c in used]) for f in (np.min, np.max))
    size = np.array([(cell == c).sum() for c in used])
    most = np.array([max(((cell == c) & (group == g)).sum() for g in range(3)) for c in used])
    cells.set_boxes(used, low, high, size, most)
    for k in (1, 8, 40, 150, 1000):
        reach = cells.reach(x, cells.assign(x), np.ones(80, bool), k)
        assert np.isfinite(reach).all()
        for i, v in enumerate(x):
            dist = np.sqrt(sum((v[j] - ref[:, j]) ** 2 for j in range(5)))
            for g in range(3):
                assert (dist[group != g] <= reach[i]).sum() >= min(k, (group != g).sum())


def test_boxes_in_reach_are_found_in_bounded_memory():
    import tracemalloc

    ref, x = _data(15, 4000, "normal"), _data(16, 4000, "normal")
    cells = build_cells(ref, 8)
    cell = cells.assign(ref)
    used, size = np.unique(cell, return_counts=True)
    low, high = (np.array([f(ref[cell == c], axis=0) for c in used]) for f in (np.min, np.max))
    cells.set_boxes(used, low, high, size, size)
    radius = np.full(len(x), 1.5)
    tracemalloc.start()
    row, found = cells.within(x, radius)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    gap = np.maximum(np.maximum(low[None] - x[:, None], x[:, None] - high[None]), 0)
    want = np.argwhere(np.sqrt((gap * gap).sum(axis=2)) <= 1.5)
    assert sorted(zip(row, found)) == [(r, used[c]) for r, c in want]
    assert len(row) > 300_000 and peak < 100 * len(row)


def test_answer_once_for_every_different_vector(spark):
    """Votes are worked out below the join that gives every row its answer, and are the same in both plans."""
    ref, x = _data(1, 400, "heavy"), np.repeat(_data(2, 20, "heavy"), 30, axis=0)
    rows = _frame(spark, x).unionByName(spark.createDataFrame([(600, None, 1.0, 1.0, 1.0, 1.0, 0, 0)], _frame(spark, x).schema))
    reference = _frame(spark, ref, np.arange(400) % 5)
    shares = [
        voting.knn_shares(rows, NeighborModel.fit(reference, k=12, cell_rows=40, **limits), 12).select("id", "shares") for limits in LIMITS
    ]
    for found in shares[1:]:
        above, _, below = found._jdf.queryExecution().optimizedPlan().toString().partition("Join")
        assert "lambdafunction" not in above
        assert "lambdafunction" in below
    here, *others = [{r.id: [(s.Class, round(s.Prob, 9)) for s in r.shares] for r in found.collect()} for found in shares]
    assert len(here) == 601
    assert here[600] == []
    assert all(other == here for other in others)


REGIONS = [{"region_rows": 1}, {"region_rows": 60}, {"region_rows": 200, "slot_rows": 10**6, "block_rows": 10**6}]


@pytest.mark.parametrize("limits", REGIONS, ids=["cells", "cut", "whole"])
@pytest.mark.parametrize("kind", ["normal", "grid", "heavy"])
def test_regions_of_small_cells(spark, kind, limits):
    """Regions of one cell and of many, some of them cut by rows and by queries."""
    x = _data(17, 1500, kind)
    fold = np.arange(1500) % 10
    frame = _frame(spark, x, fold=fold)
    model = NeighborModel.fit(frame, k=9, apart="fold", cell_rows=20, broadcast_rows=0, **{"slot_rows": 20, "block_rows": 7} | limits)
    assert model.cells.depth > model.shift and (model.shift > 0) == (limits["region_rows"] > 20)
    assert _got(model.neighbors(frame, apart="fold")) == dict(enumerate(_brute(x, x, 9, (fold, fold))))


def test_a_query_is_not_sent_to_every_small_cell(spark, monkeypatch):
    """What is shuffled is counted: cells smaller than k hold no near k-th neighbour, and a region is visited once for all of its cells."""
    sent, found = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    task = NeighborModel._search_task

    def counted(self, k):
        run = task(self, k)

        def count(queries, reference):
            answers = run(queries, reference)
            sent.add(queries.num_rows)
            found.add(sum(answers.column("neighbors").combine_chunks().value_lengths().to_pylist()))
            return answers

        return count

    monkeypatch.setattr(NeighborModel, "_search_task", counted)
    frame = _frame(spark, _data(18, 6000, "normal"), fold=np.arange(6000) % 10)
    model = NeighborModel.fit(frame, k=20, apart="fold", cell_rows=16, broadcast_rows=0, slot_rows=100, block_rows=8)
    assert model.neighbors(frame, apart="fold").filter("size(neighbors) = 20").count() == 6000
    assert sent.value < 6000 * 10
    assert found.value < 6000 * 20 * 5


def test_cells_under_a_node():
    cells = build_cells(_data(19, 500, "normal"), 3)
    first, last = cells.under(np.arange(15))
    assert list(zip(first, last)) == [(0, 8), (0, 4), (4, 8), (0, 2), (2, 4), (4, 6), (6, 8), *((c, c + 1) for c in range(8))]


@pytest.mark.parametrize("kind", ["normal", "grid", "heavy"])
def test_index_by_blocks_of_few_rows(kind):
    """Cells smaller than k, cut in blocks, met by few queries at a time; one group alone in a corner."""
    ref, x = _data(20, 600, kind), _data(21, 100, kind)
    group, own = (ref[:, 0] > np.median(ref[:, 0])).astype(int), np.arange(100) % 3
    index = Index.build(Rows(ref, np.arange(600), np.zeros(600, int), group), 6, 4)
    got = [[] for _ in x]
    for q, r, d in zip(*index.search(x, own, 12, queries=7)):
        got[q].append((float(d), int(index.rows.id[r])))
    assert got == _brute(x, ref, 12, (own, group))
