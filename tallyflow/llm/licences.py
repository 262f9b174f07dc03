"""Licence scans: trained paragraph classifier, unknown class, confirmation by templates.

A paragraph is a run of lines that hold a letter or a digit, so a notice may be wrapped and
stand behind comment marks; lines without (blank ones, rules, bare comment marks) part paragraphs. Paragraphs
are read in pieces of ``PIECE`` words, each beginning ``STRIDE`` words after the last, so that a notice is
not lost in a long paragraph. A logistic regression (one row of weights for each family and one for "unknown") over
hashed word 1-grams and 2-grams is trained on variations of each family's notices (``NOTICES``) and
on a bounded sample of the corpus's own pieces as unknown. Its elastic-net penalty leaves few weights.

Pieces that are some notice with probability ``LEAST`` or more are compared with the notices of the likeliest family: the
family is confirmed if they hold ``CONTAINED`` of the word 3-grams of a notice (2-grams of a notice of two words), or if that
share of their own 3-grams, ``SHARED`` of them at least, lies in one notice (a part of a notice). Other families of
probability ``SECOND`` or more are confirmed if a share of ``FULL`` is reached, so a piece may name several.
A quarter of all paragraphs, chosen by the hash of their text, is never trained on; the threshold is set on
all of these, by a histogram, so that at most ``FALSE_SHARE`` of them exceed it without being confirmed.

All stages are DataFrame functions and Spark ML, without Python on the executors.

Defined results: a NULL or empty text has no paragraph; repeated rows are treated alike; other columns are not
read; an empty table gives an empty one, a table without sample paragraphs is scanned by the notices
against each other. "proprietary" is listed only where no other family is, as open notices reserve rights too.
A word of more than nine parts joined by dots or hyphens counts as several.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.session import materialize

#: Public notices of common licence families, at most 28 words each.
NOTICES = {
    "apache": [
        "licensed under the apache license version 2.0",
        "licensed under the apache license, version 2.0 (the \"license\"); you may not use this file except in compliance with the license",
        "released under the apache license 2.0",
        "apache license version 2.0, january 2004",
        "spdx-license-identifier: apache-2.0",
    ],
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "spdx-license-identifier: mit",
    ],
    "isc": [
        "released under the isc license",
        "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "spdx-license-identifier: isc",
    ],
    "bsd": [
        "released under the bsd license",
        "licensed under the bsd 3-clause license",
        "licensed under the bsd 2-clause license",
        "use of this source code is governed by a bsd-style license",
        "redistribution and use in source and binary forms, with or without modification, are permitted",
        "spdx-license-identifier: bsd-2-clause",
        "spdx-license-identifier: bsd-3-clause",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license, version 3",
        "licensed under the gnu general public license version 2",
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license",
        "you should have received a copy of the gnu general public license along with this program",
        "spdx-license-identifier: gpl-2.0",
        "spdx-license-identifier: gpl-2.0-only",
        "spdx-license-identifier: gpl-2.0-or-later",
        "spdx-license-identifier: gpl-3.0-only",
        "spdx-license-identifier: gpl-3.0-or-later",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license",
        "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license",
        "spdx-license-identifier: lgpl-2.1-or-later",
        "spdx-license-identifier: lgpl-3.0-or-later",
    ],
    "agpl": [
        "licensed under the gnu affero general public license version 3",
        "you can redistribute it and/or modify it under the terms of the gnu affero general public license",
        "spdx-license-identifier: agpl-3.0-only",
        "spdx-license-identifier: agpl-3.0-or-later",
    ],
    "mpl": [
        "licensed under the mozilla public license, version 2.0",
        "this source code form is subject to the terms of the mozilla public license",
        "spdx-license-identifier: mpl-2.0",
    ],
    "epl": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license",
        "spdx-license-identifier: epl-2.0",
    ],
    "boost": [
        "distributed under the boost software license, version 1.0",
        "spdx-license-identifier: bsl-1.0",
    ],
    "zlib": [
        "this software is provided 'as-is', without any express or implied warranty. in no event will the authors be held liable",
        "spdx-license-identifier: zlib",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain",
        "spdx-license-identifier: unlicense",
    ],
    "cc": [
        "licensed under cc by-nc 4.0",
        "licensed under cc by 4.0",
        "licensed under cc by-sa 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license",
        "this work is licensed under a creative commons attribution-sharealike 4.0 international license",
        "spdx-license-identifier: cc-by-4.0",
        "spdx-license-identifier: cc-by-sa-4.0",
    ],
    "cc0": [
        "to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "spdx-license-identifier: cc0-1.0",
    ],
    "proprietary": [
        "all rights reserved",
        "all rights reserved. no part of this work may be reproduced without permission",
        "proprietary and confidential. unauthorized copying of this file is prohibited",
    ],
}
UNKNOWN, WEAK = "unknown", "proprietary"
FAMILIES = [UNKNOWN, *NOTICES]
WORD = "[a-z0-9]+(?:[.-][a-z0-9]+){0,8}"
#: From the end of a line to that of the last of the lines after it that hold neither letter nor digit.
PARTING = r"\n[^\p{L}\p{N}]*\n"
PIECE, STRIDE = 96, 80
SLOTS = 1 << 14
SAMPLE = 20_000
LEAST, BINS = 0.5, 1000
FALSE_SHARE = 0.001
CONTAINED, SHARED = 0.75, 4
SECOND, FULL = 0.005, 0.95
FOLDS = 4
#: Training variations put this many words of one of LENDERS corpus pieces on either side of a notice.
AROUND = (0, 4, 12, 34)
LENDERS = 64


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _plain(notice: str) -> list[str]:
    return re.findall(WORD, notice.lower())


def _runs(words: list[str]) -> list[str]:
    n = min(3, len(words))
    return sorted({" ".join(words[i : i + n]) for i in range(len(words) - n + 1)})


def grams(words: Column, n: int) -> Column:
    """Runs of n words; none of fewer words."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.concat_ws(" ", F.slice(words, i, n)))
    return F.when(F.size(words) < n, F.array().cast("array<string>")).otherwise(runs)


def blocks(text: Column) -> Column:
    """The paragraphs of a text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), PARTING, -1), lambda x: x.rlike(r"[\p{L}\p{N}]"))


def _held_out(turn: Column) -> Column:
    return F.pmod(turn, F.lit(FOLDS)) == 0


def paragraphs(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``id, at`` (from 0), ``turn`` (a hash of the text), ``paragraph``."""
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.posexplode(blocks(F.col(f"`{text}`"))).alias("at", "paragraph"))
    return rows.select("id", "at", F.xxhash64("paragraph").alias("turn"), "paragraph")


def _pieces(rows: DataFrame) -> DataFrame:
    """The paragraphs' pieces: ``id, at, turn, piece`` (from 0), ``words``."""
    words = rows.select("id", "at", "turn", words_of(F.col("paragraph")).alias("all")).filter(F.size("all") > 0)
    last = F.ceil(F.greatest(F.size("all") - PIECE, F.lit(0)) / F.lit(STRIDE)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("all", k * STRIDE + 1, PIECE))
    return words.select("id", "at", "turn", F.posexplode(cut).alias("piece", "words"))


@dataclass
class Scanner:
    """A fitted classifier; without a ``threshold``, a scan sets one on what it scans."""

    model: object
    hashing: HashingTF
    threshold: float | None = None


def _featured(rows: DataFrame, hashing: HashingTF) -> DataFrame:
    """``rows`` with ``words`` and their hashed 1-grams and 2-grams."""
    pairs = F.zip_with("words", F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return hashing.transform(rows.withColumn("grams", F.concat(F.col("words"), pairs)))


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Scanner:
    """Fit on about ``sample`` corpus paragraphs and at most as many of their different pieces (least hash first), and the notices' variations."""
    spark = docs.sparkSession
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=SLOTS, binary=True)
    total = docs.agg(F.sum(F.size(blocks(F.col(f"`{text}`")))).alias("n")).first()["n"] or 0
    # The cut comes before any sort, so that a task holds its share of the sample and not the whole.
    cut = 2 * int(min(1.0, sample / max(total, 1) * FOLDS / (FOLDS - 1)) * 2**62) - 1
    turn = F.col("turn")
    chosen = paragraphs(docs, id, text).filter(~_held_out(turn) & (F.shiftrightunsigned(turn, 1) <= cut))
    chosen = _pieces(chosen).select(F.xxhash64("words").alias("key"), "words").dropDuplicates(["key"])
    chosen = materialize(chosen.orderBy("key").limit(sample), "pieces")
    flat = [(f, _plain(n)) for f, many in NOTICES.items() for n in many]
    every = sorted({run for _, n in flat for run in _runs(n)})
    # Pieces that hold parts of notices are no examples of the unknown class.
    own = F.concat(grams(F.col("words"), 3), grams(F.col("words"), 2))
    clean = chosen.filter(F.size(F.array_intersect(F.lit(every), own)) < SHARED - 1)
    lenders = clean.orderBy("key").limit(LENDERS).select("words").collect()
    halves = [(f, h) for f, n in flat if len(n) >= 12 for h in (n[: len(n) // 2 + 1], n[-(len(n) // 2) - 1 :])]
    made = [(float(FAMILIES.index(f)), n) for f, n in flat + halves]
    for i, lender in enumerate(lenders):
        n = AROUND[i % len(AROUND)]
        before, after = lender["words"][:n], lender["words"][n : 2 * n]
        made += [(float(FAMILIES.index(f)), [*before, *notice, *after]) for f, notice in flat + halves]
    known_rows = spark.createDataFrame(made, "label double, words array<string>")
    rows = materialize(_featured(clean.select(F.lit(0.0).alias("label"), "words").union(known_rows), hashing).select("label", "features"), "licences")
    model = LogisticRegression(family="multinomial", maxIter=40, regParam=2e-3, elasticNetParam=0.5).fit(rows)
    return Scanner(model, hashing)


def _share(words: Column, family: Column) -> Column:
    """How much of a notice of the family the words hold, or of the words a notice holds; the largest over its notices."""
    table = F.create_map(*[F.lit(x) for f, many in NOTICES.items() for x in (f, [" ".join(_plain(n)) for n in many])])
    threes = grams(words, 3)

    def of(notice: Column) -> Column:
        own = F.split(notice, " ")
        runs = F.array_distinct(F.when(F.size(own) < 3, F.array(notice)).otherwise(grams(own, 3)))
        both = F.size(F.array_intersect(runs, F.concat(threes, grams(words, 2))))
        part = F.when(both >= SHARED, both / F.size(F.array_distinct(threes))).otherwise(0.0)
        return F.greatest(both / F.size(runs), F.least(part, F.lit(1.0)))

    return F.array_max(F.transform(F.element_at(table, family), of))


def likely(docs: DataFrame, scanner: Scanner, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces that are a notice with probability ``LEAST`` or more: ``id, at, piece, turn, family`` (the likeliest), ``probability,
    share, confirmed, families`` (those confirmed, sorted)."""
    rows = _pieces(paragraphs(docs, id, text))
    scored = scanner.model.transform(_featured(rows, scanner.hashing))
    scored = scored.select("id", "at", "piece", "turn", "words", vector_to_array("probability").alias("p"))
    scored = scored.withColumn("probability", 1 - F.element_at("p", 1)).filter(F.col("probability") >= LEAST)
    scored = scored.withColumn("p", F.slice("p", 2, len(NOTICES)))
    first = F.array_position("p", F.array_max("p")).cast("int")
    scored = scored.withColumn("family", F.element_at(F.lit(FAMILIES[1:]), first))
    asked = F.filter(F.arrays_zip(F.lit(FAMILIES[1:]).alias("name"), F.col("p")), lambda x: (x["p"] >= SECOND) | (x["name"] == F.col("family")))
    shares = F.transform(asked, lambda x: F.struct(x["name"].alias("name"), _share(F.col("words"), x["name"]).alias("share")))
    rows = scored.withColumn("shares", shares)
    kept = F.filter("shares", lambda x: x["share"] >= F.when(x["name"] == F.col("family"), CONTAINED).otherwise(FULL))
    own = F.element_at(F.filter("shares", lambda x: x["name"] == F.col("family")), 1)["share"]
    families = F.array_sort(F.transform(kept, lambda x: x["name"]))
    rows = rows.select("id", "at", "piece", "turn", "family", "probability", own.alias("share"), families.alias("families"))
    return rows.withColumn("confirmed", F.size("families") > 0)


def threshold_of(found: DataFrame, held: int) -> float:
    """Least of BINS thresholds that at most ``FALSE_SHARE`` of ``held`` held-out paragraphs exceed unconfirmed."""
    false = found.filter(_held_out(F.col("turn"))).groupBy("id", "at", "turn").agg(F.max("probability").alias("p"), F.max("confirmed").alias("sure"))
    bins = false.filter("not sure").groupBy(F.floor(F.col("p") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    above = 0
    for row in bins.orderBy(F.desc("bin")).collect():  # at most BINS rows
        above += row["n"]
        if above > FALSE_SHARE * held:
            return min(1.0, (row["bin"] + 1) / BINS)
    return LEAST


def licence_scan(docs: DataFrame, scanner: Scanner, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: ``id, n_paragraphs, n_predicted, n_confirmed, licences``.

    ``licences`` lists the confirmed families, sorted and comma-joined, or ``unknown``
    if paragraphs were predicted but none confirmed, or is empty.
    """
    source = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    held = F.filter(blocks(F.col("text")), lambda x: _held_out(F.xxhash64(x)))
    rows = source.select("id", F.xxhash64("text").alias("key"), F.size(blocks(F.col("text"))).cast("long").alias("n_paragraphs"), F.size(held).alias("held"))
    found = likely(source.select(F.struct("id", F.xxhash64("text").alias("key")).alias("id"), "text"), scanner, "id", "text")
    found = materialize(found, "likely")
    limit = scanner.threshold
    if limit is None:
        limit = threshold_of(found, rows.agg(F.sum("held").alias("n")).first()["n"] or 0)
    found = found.filter(F.col("probability") >= limit)
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set("families"))))  # sets of a few families
    found = found.groupBy("id").agg(
        F.count_distinct("at").alias("n_predicted"), F.count_distinct(F.when(F.col("confirmed"), F.col("at"))).alias("n_confirmed"), names.alias("names")
    )
    names = F.array_join(F.when(F.size("names") > 1, F.array_remove("names", WEAK)).otherwise(F.col("names")), ",")
    found = found.select(F.col("id.id").alias("f_id"), F.col("id.key").alias("f_key"), "n_predicted", "n_confirmed", names.alias("names"))
    joined = rows.join(found, rows["id"].eqNullSafe(found["f_id"]) & (rows["key"] == found["f_key"]), "left")
    names = F.when(F.length("names") > 0, F.col("names")).when(F.col("n_predicted") > 0, F.lit(UNKNOWN)).otherwise(F.lit(""))
    return joined.select(
        F.col("id").alias(id),
        "n_paragraphs",
        F.coalesce("n_predicted", F.lit(0)).alias("n_predicted"),
        F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"),
        names.alias("licences"),
    )
