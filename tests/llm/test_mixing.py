"""Targets, least-cost routing, takings."""

import itertools
import random

from tallyflow.llm import mixing as M
from tests.llm.brute import odd_frame


def test_targets_are_shared_out():
    assert M.share_out([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    targets = M.share_out([10, 100, 50, 0], [1, 2, 3, 1])
    assert abs(sum(targets) - 160) < 1e-9 and targets[3] == 0 and targets[0] <= 30
    assert M.share_out([], []) == [] and M.share_out([0], [1]) == [0]


def cost(flow, patterns, copies):
    total = 0
    for p, (_, size) in enumerate(patterns):
        sent = sum(v for (q, _), v in flow.items() if q == p)
        for layer in range(copies):
            total += layer * min(max(sent - layer * size, 0), size)
    return total


def test_route_has_the_largest_flow_and_least_cost():
    r = random.Random(2)
    for _ in range(30):
        patterns = [(tuple(sorted(r.sample(range(2), r.randrange(1, 3)))), r.randrange(0, 4)) for _ in range(3)]
        quotas = [float(r.randrange(0, 9)) for _ in range(2)]
        flow = M.route(patterns, quotas)
        best = None
        for split in itertools.product(*[range(3 * size + 1) for _, size in patterns], *[range(3 * size + 1) for _, size in patterns]):
            a, b = split[:3], split[3:]
            if any(x + y > 3 * s or (x and 0 not in m) or (y and 1 not in m) for x, y, (m, s) in zip(a, b, patterns)):
                continue
            if sum(a) <= quotas[0] and sum(b) <= quotas[1]:
                trial = {(p, 0): x for p, x in enumerate(a)} | {(p, 1): y for p, y in enumerate(b)}
                key = (-sum(split), cost(trial, patterns, 3))
                best = key if best is None else min(best, key)
        assert abs(sum(flow.values()) + best[0]) < 1e-6 and abs(cost(flow, patterns, 3) - best[1]) < 1e-6


def test_taken_words_meet_targets(spark):
    r = random.Random(1)
    rows = [(i, "w " * r.randrange(0, 60), r.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    rows = [(i, t, s) for i, t, s in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = M.mix_sources(docs).collect()
    again = M.mix_sources(docs.repartition(5)).collect()
    assert sorted(out) == sorted(again) and len(out) == len(rows)
    source = {i: s for i, _, s in rows}
    size = {i: len(t.split()) for i, t, _ in rows}
    total = sum(size.values())
    sizes = {s: sum(n for i, n in size.items() if source[i] == s) for s in ("a", "b", "c", None)}
    targets = dict(zip(sizes, M.share_out(list(sizes.values()), [1, 2, 3, 1])))
    taken = dict.fromkeys(sizes, 0)
    for x in out:
        assert x["size"] == size[x["doc_id"]] and x["source_size"] == sizes[source[x["doc_id"]]]
        assert 0 <= x["taken"] <= 3 * x["size"] and abs(x["target"] - targets[source[x["doc_id"]]]) < 1e-6
        taken[source[x["doc_id"]]] += x["taken"]
    assert abs(sum(targets.values()) - total) < 1e-6
    assert all(abs(taken[s] - targets[s]) <= 5 for s in sizes)


def test_odd_documents(spark):
    docs = odd_frame(spark)
    out = M.mix_sources(docs, keep=True)
    assert out.columns == [*docs.columns, "mix_size", "source_size", "target", "taken"]
    rows = out.collect()
    assert len(rows) == docs.count()
    assert all(r["taken"] == 0 for r in rows if not (r["text"] or "").strip())
    assert M.mix_sources(docs.limit(0)).count() == 0


def test_rows_without_or_with_one_id_meet_targets_to_a_word(spark):
    rows = [(None, "un deux trois", "a")] * 2000 + [(i, "w " * 100, "b") for i in range(100)]
    rows += [(7, "x " * (i % 5), "c") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    out = M.mix_sources(docs).collect()
    assert sorted(map(str, out)) == sorted(map(str, M.mix_sources(docs.repartition(3)).collect()))
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abc"}
    targets = dict(zip("abc", M.share_out(list(sizes.values()), [1, 2, 3])))
    for s in "abc":
        mine = [x for x in out if x["source_size"] == sizes[s] and abs(x["target"] - targets[s]) < 1e-6]
        assert abs(sum(x["taken"] for x in mine) - targets[s]) <= 0.5
        # All but one row are taken in whole copies, which differ by one at the most.
        parts = [x for x in mine if x["size"] and x["taken"] % x["size"]]
        assert len(parts) <= 1 and all(0 <= x["taken"] <= 3 * x["size"] for x in mine)
        assert len({x["taken"] // x["size"] for x in mine if x["size"]}) <= 2


def test_overlapping_sources_meet_targets(spark):
    rows = [(i, "w " * (1 + i % 7), ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b"]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    out = M.mix_sources(docs, members=M.F.col("source")).collect()
    assert sum(x["taken"] for x in out) == sum(1 + i % 7 for i in range(400))
    assert all(0 <= x["taken"] <= 3 * x["size"] for x in out)
