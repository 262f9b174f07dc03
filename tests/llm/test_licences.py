"""Paragraphs, wrapped and partial notices of every family, the unknown class."""

import random
import re

import pytest

from tallyflow.llm import licences as C
from tests.llm.brute import odd_frame

ROWS = "doc_id long, text string"
COMMON = ["ta", "re", "mo", "li", "under", "the", "version", "license", "is", "of", "software", "work", "public", "general"]


def prose(r, n):
    return " ".join(r.choice(COMMON) + r.choice(["", "n", "sh", "ing"]) for _ in range(n))


def wrapped(notice, width, mark):
    words, lines = notice.split(), []
    for i in range(0, len(words), width):
        lines.append(mark + " ".join(words[i : i + width]))
    return "\n".join(lines)


@pytest.fixture(scope="module")
def scanner(spark):
    r = random.Random(3)
    rows = [(i, "\n\n".join("\n".join(prose(r, 12) for _ in range(r.randrange(1, 12))) for _ in range(4))) for i in range(400)]
    return C.train(spark.createDataFrame(rows, ROWS))


def licences(spark, scanner, texts):
    r = random.Random(8)
    rows = list(enumerate(texts)) + [(10_000 + i, prose(r, 300)) for i in range(300)]
    out = {x["doc_id"]: x for x in C.licence_scan(spark.createDataFrame(rows, ROWS), scanner).collect()}
    assert not any(out[10_000 + i]["licences"] not in ("", C.UNKNOWN) for i in range(300))
    return [out[i]["licences"] for i in range(len(texts))]


def test_notices_of_every_family_wrapped_and_within_prose(spark, scanner):
    r = random.Random(5)
    texts, families = [], []
    for family, notices in C.NOTICES.items():
        for notice in notices:
            for width, mark, before, after in ((99, "", 0, 0), (4, "", 0, 0), (5, " * ", 0, 0), (3, "// ", 40, 40), (6, "# ", 200, 7), (99, "", 500, 500)):
                parts = [prose(r, before), wrapped(notice.capitalize(), width, mark), prose(r, after)]
                texts.append("\n".join(p for p in parts if p))
                families.append(family)
    got = licences(spark, scanner, texts)
    wrong = [(f, g, t[:60]) for f, g, t in zip(families, got, texts) if f not in g.split(",")]
    assert len(wrong) <= 0.03 * len(texts), (len(wrong), len(texts), wrong[:20])


def test_standard_headers(spark, scanner):
    gpl = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */"""
    mit = "Permission is hereby granted, free of charge, to any person obtaining a\ncopy of this software and associated documentation files, to deal in the Software"
    start = "Permission is hereby granted, free of charge, to any"
    texts = [gpl, mit, start, "All rights reserved.", "// SPDX-License-Identifier: Apache-2.0", "a fishing license is needed", None, "", " \n\n--\n"]
    texts.append("Released under the MIT License.\n\n-----\n\nLicensed under CC BY-NC 4.0.\nAll rights reserved.")
    got = licences(spark, scanner, texts)
    assert got[:5] == ["gpl", "mit", "mit", "proprietary", "apache"]
    assert got[5] in ("", C.UNKNOWN) and got[6:9] == ["", "", ""] and got[9] == "cc,mit"


def test_paragraphs_and_pieces_against_plain_python(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(["\n", "\n", " ", "a", "bc d", "*", "-", "é", "1.2-x", "\r\n", "\t"]) for _ in range(r.randrange(0, 60))) for _ in range(300)]
    texts += ["w " * 500, "\n" * 50_000 + "a", "1." * 50_000, "a" * 200_000, "\n".join(["x y"] * 3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), ROWS)
    got = {}
    for x in C._pieces(C.paragraphs(docs, "doc_id", "text")).collect():
        got.setdefault((x["id"], x["at"]), {})[x["piece"]] = x["words"]
    for i, text in enumerate(texts):
        found, lines = [], []
        for line in [*text.split("\n"), ""]:
            if any(c.isalnum() for c in line):
                lines.append(line)
            elif lines:
                found.append("\n".join(lines))
                lines = []
        for at, paragraph in enumerate(found):
            words = re.findall(C.WORD, paragraph.lower())
            want = [words[a : a + C.PIECE] for a in range(0, max(1, len(words) - C.PIECE + C.STRIDE), C.STRIDE)] if words else []
            mine = got.pop((i, at), {})
            assert [mine[k] for k in range(len(mine))] == want
    assert not got


def test_threshold_by_histogram(spark):
    r = random.Random(2)
    rows = [(i, 0, 0, 4 * i, "mit", r.uniform(0.5, 1), 0.1, r.random() < 0.2) for i in range(400)] + [(i, 0, 0, 1, "mit", 0.99, 0.1, False) for i in range(50)]
    found = spark.createDataFrame(rows, "id long, at int, piece int, turn long, family string, probability double, share double, confirmed boolean")
    got = C.threshold_of(found, 100_000)
    false = [x[5] for x in rows if x[3] % 4 == 0 and not x[7]]
    assert sum(p >= got for p in false) <= 100 < sum(p >= got - 1 / C.BINS for p in false) + 1
    assert C.threshold_of(found, 10**7) == C.LEAST and C.threshold_of(found.limit(0), 0) == C.LEAST


def test_odd_documents(spark, scanner):
    docs = odd_frame(spark).withColumnRenamed("size", "words").withColumnRenamed("n_chars", "id").withColumnRenamed("lang", "key")
    out = C.licence_scan(docs, scanner)
    assert out.columns == ["doc_id", "n_paragraphs", "n_predicted", "n_confirmed", "licences"] and out.count() == docs.count()
    assert C.licence_scan(docs.limit(0), scanner).count() == 0
    empty = C.train(docs.limit(0))
    assert C.licence_scan(spark.createDataFrame([(1, "Released under the MIT License.")], ROWS), empty).first()["licences"] == "mit"
