"""Hits against brute force; blocks; removal of documents and spans."""

import hashlib

import pytest

from tallyflow.llm import decontamination as D
from tests.llm.brute import odd_frame, odd_rows, words

ITEMS = [
    (1, " ".join(f"b{i}" for i in range(30))),
    (2, " ".join(f"B{i}," for i in range(5, 25))),
    (3, "One TWO"),
    (4, None),
    (5, "!!!"),
    (None, "no id"),
    (3, "one two"),
]
DOCS = [
    (100, "start " + " ".join(f"b{i}" for i in range(3, 20)) + " end"),
    (101, " ".join(f"b{i}" for i in range(12)) + " gap " + " ".join(f"b{i}" for i in range(12, 24))),
    (102, "x " * 1000 + "one two"),
    (103, "one-two three"),
    (103, "one-two three"),
    (104, "clean words only"),
]


def brute(text, items):
    w = words(text)
    hit, ids = set(), set()
    for item, body in items:
        b = words(body)
        n = min(13, len(b))
        found = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        at = [i for i in range(len(w) - n + 1) if n and tuple(w[i : i + n]) in found]
        hit |= {i + k for i in at for k in range(n)}
        if at and item is not None:
            ids.add(str(item))
    digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    return len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [10**6, 40])
def test_report_equals_brute_force(spark, block):
    rows = [(i, t) for i, t, *_ in odd_rows()] + DOCS
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((tuple(r) for r in D.contamination(docs, items, block_words=block).collect()), key=repr)
    assert got == sorted(((i, *brute(t, ITEMS)) for i, t in rows), key=repr)


@pytest.mark.parametrize("block", [10**6, 40])
def test_removal(spark, block):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").unionByName(odd_frame(spark), allowMissingColumns=True)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = D.decontaminate(docs, items, block_words=block)
    assert kept.dtypes == docs.dtypes
    bad = sum(brute(r["text"], ITEMS)[-1] for r in docs.collect())
    assert bad and kept.count() == docs.count() - bad
    cut = {r["doc_id"]: r["text"] for r in D.decontaminate(docs, items, mode="spans", block_words=block).collect()}
    assert cut[100] == "start  end" and cut[103] == " three" and cut[104] == "clean words only"
    assert D.decontaminate(docs, items.limit(0)).count() == docs.count()
    assert D.contamination(docs.limit(0), items).count() == 0
