"""Classes against all pairs, alignment against the plain table, odd documents."""

import functools
import random

import numpy as np
import pytest

from tallyflow.llm import order_minhash as O
from tests.llm.brute import SCHEMA, labelled, longest_common, odd_frame


def corpus():
    r = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    rows, common = [], [r.choice(vocabulary) for _ in range(60)]
    for i in range(40):
        base = [r.choice(vocabulary) for _ in range(r.randrange(30, 200))]
        if i % 4 == 0:
            base = common + base
        rows.append((len(rows), " ".join(base)))
        for _ in range(r.randrange(0, 4) if i else 30):
            copy = list(base)
            for _ in range(r.randrange(1, 5)):
                copy[r.randrange(len(copy))] = "edit" + str(r.randrange(50))
            rows.append((len(rows), " ".join(copy)))
    return rows


def classes_by_all_pairs(rows):
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    held = {i: labelled(t) for i, t in rows}
    for i, a in held.items():
        for j, b in held.items():
            if i < j and len(set(a) & set(b)) * 1.8 >= 0.8 * (len(a) + len(b)) - 1e-9:
                m = longest_common(a, b)
                if m / (len(a) + len(b) - m) >= 0.8:
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def test_classes_equal_all_pairs(spark):
    rows = corpus()
    got = O.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == classes_by_all_pairs(rows)


def copies_of_copies():
    """A base, copies with one edited word, and of each copy a copy with four, which is near to it only."""
    r = random.Random(21)
    base = [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(20):
        places = r.sample(range(0, 200, 6), 5)
        copy = list(base)
        copy[places[0]] = f"first{i}"
        rows.append((len(rows), " ".join(copy)))
        for place in places[1:]:
            copy[place] = f"second{i}at{place}"
        rows.append((len(rows), " ".join(copy)))
    return rows


@functools.cache
def classes_of_copies():
    return classes_by_all_pairs(copies_of_copies())


@pytest.mark.parametrize("shingles", [100_000, 1000])
def test_copies_of_copies_in_a_crowd_equal_all_pairs(spark, monkeypatch, shingles):
    monkeypatch.setattr(O, "BLOCK_SHINGLES", shingles)
    got = O.near_duplicates(spark.createDataFrame(copies_of_copies(), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == classes_of_copies()


def test_alignment_equals_plain_table():
    r = random.Random(9)
    for _ in range(200):
        a = np.array(r.sample(range(60), r.randrange(1, 40)))
        b = np.array(r.sample(range(60), r.randrange(1, 40)))
        want = longest_common(a.tolist(), b.tolist())
        for need in range(1, want + 2):
            got = O.aligned(a, b, need)
            assert got == want if want >= need else got < need


def test_odd_documents(spark):
    docs = odd_frame(spark)
    rows = O.near_duplicates(docs).collect()
    of = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in rows}
    assert len(rows) == docs.count()
    assert of[1] == (1, 1) and of[2] == (2, 2) and of[3] == (2, 2) and of[5] == of[4] == of[6] and of[4][0] == 4
    kept = O.drop_near_duplicates(docs)
    assert kept.schema == docs.schema
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 4, 7, 8, 9, 10]
    empty = spark.createDataFrame([], SCHEMA)
    assert O.near_duplicates(empty).count() == 0 and O.drop_near_duplicates(empty).count() == 0


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")] * 3 + [(2, "x y z")] * 2, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in O.drop_near_duplicates(docs).collect()) == [1, 2]


def test_no_frames_from_python_lists(spark, monkeypatch):
    """A frame made of a Python list runs in Python workers of its own, which stay beside those of the sketches."""
    docs = spark.createDataFrame(corpus()[:60], "doc_id long, text string").repartition(3).localCheckpoint()

    def refused(*_, **__):
        raise AssertionError("frame from a Python list")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    assert O.near_duplicates(docs).count() == 60
    assert O.drop_near_duplicates(docs).count() < 60
