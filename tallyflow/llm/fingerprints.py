"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

A shingle (five words; a text of fewer words, but not none, is one shingle) is hashed once.
The hash's high bits name one of ``BINS`` bins, which keeps its least hash; an empty
bin takes the value of a filled one, found by a fixed sequence of random bins (the
same for all texts), so equal sets fill equally. Of each bin the lowest ``BITS`` bits are
kept, written as hexadecimal digits. Two unlike texts agree in a bin by chance once in
2**BITS times; ``likeness`` takes that out.

``edited_fingerprints`` compares each document with an edited form of it, whose
second half is the beginning of the next document, and with that next document.
Neighbours by id meet by a range partitioning: the bounds are ids that occur, so
the row that a range needs of the one below it is the row at the bound, which is sent
to both. Texts are shuffled once, compressed.

Defined results: NULL and empty texts, and texts without words, have the fingerprint
of no shingles, an empty string, which is like itself (1) and unlike others (0);
NULL ids come after all others; rows with equal ids follow each other by text; a
single row is its own next; other columns are not read; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.text import ALNUM, Words, chunks, mix, windows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 5
BINS, BITS = 256, 4
EMPTY_BIN = np.uint64(2**64 - 1)
PROBES = 64


def probes() -> np.ndarray:
    """For every bin, the bins it asks for a value, in turn."""
    seeds = np.arange(BINS * PROBES, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D)
    return (mix(seeds) >> np.uint64(32)).astype(np.int64).reshape(BINS, PROBES) % BINS


def densified(least: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Bins of some texts (rows), every empty one filled from another; rows without values stay."""
    filled = least != EMPTY_BIN
    out = least.copy()
    rows, bins = np.nonzero(~filled & filled.any(1)[:, None])
    for turn in range(PROBES):
        if not len(rows):
            return out
        source = table[bins, turn]
        good = filled[rows, source]
        out[rows[good], bins[good]] = least[rows[good], source[good]]
        rows, bins = rows[~good], bins[~good]
    for row, bin_ in zip(rows.tolist(), bins.tolist()):  # few filled bins: the next one at or after the last probe
        ring = np.roll(filled[row], -int(table[bin_, -1]))
        out[row, bin_] = least[row, (int(np.argmax(ring)) + int(table[bin_, -1])) % BINS]
    return out


def packed(column, width: int = WIDTH) -> list[str]:
    """Fingerprints of a string column."""
    table, out = probes(), []
    for a, b, data, offsets in chunks(column):
        words = Words(data, offsets, ALNUM)
        _, hashes, text = windows(words.hashes(), words.first, width, True)
        place = text * BINS + (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
        least = np.full((b - a) * BINS, EMPTY_BIN, np.uint64)
        np.minimum.at(least, place, hashes)
        least = densified(least.reshape(b - a, BINS), table)
        low = (mix(least) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
        digits = np.frombuffer(b"0123456789abcdef", np.uint8)[low]
        filled = least[:, 0] != EMPTY_BIN
        out += [d.tobytes().decode() if f else "" for d, f in zip(digits, filled)]
    return out


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity of two fingerprints, chance agreement taken out."""
    if not a or not b:
        return float(a == b)
    same = np.mean(np.frombuffer(a.encode(), np.uint8) == np.frombuffer(b.encode(), np.uint8))
    chance = 0.5**BITS
    return float(min(1.0, max(0.0, (same - chance) / (1 - chance))))


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document: ``id``, ``fingerprint``."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed(batch.column(1), width), pa.string())], ["id", "fingerprint"])

    return docs.select(F.col(id).alias("id"), text).mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first characters of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Per document: ``id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    Ids are integers. The next document is the one with the next smaller id, and
    after the last the first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if ranges is None:
        ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edge = rows.agg(F.max("id").alias("high"), F.count(F.lit(1)).alias("n"), F.count("id").alias("named")).first()
    parts = 4 * ranges  # several to a task, which evens tasks out
    steps = [i / parts for i in range(1, parts)]
    bounds = []
    if edge["named"]:
        bounds = rows.agg(F.percentile_approx("id", steps, 10_000).alias("b")).first()["b"] + [edge["high"]]
    bounds = np.array(sorted(set(bounds)), np.int64)  # range j holds the ids above bound j - 1 up to bound j
    none_first = edge["named"] < edge["n"]  # rows without an id lie below range 0, in a range of their own

    def deal(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            prints = packed(batch.column(1))
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            out = {"part": [], "guard": [], "id": [], "text": [], "print": []}

            def put(part, guard, i):
                out["part"].append(part)
                out["guard"].append(guard)
                out["id"].append(ids[i])
                out["text"].append(squeeze.compress(texts[i]))
                out["print"].append(prints[i])

            last = len(bounds) - 1
            for i, key in enumerate(ids):
                if key is None:
                    put(-1, 0, i)
                    if last >= 0:
                        put(0, 1, i)
                    continue
                j = int(np.searchsorted(bounds, key))
                put(j, 0, i)
                if key == bounds[j] and j < last:
                    put(j + 1, 1, i)
                if key == bounds[last]:  # the first of all follows the last
                    put(-1 if none_first else 0, 2, i)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["part"], pa.int32()),
                    pa.array(out["guard"], pa.int32()),
                    pa.array(out["id"], pa.int64()),
                    pa.array(out["text"], pa.binary()),
                    pa.array(out["print"], pa.string()),
                ],
                ["part", "guard", "id", "text", "print"],
            )

    dealt = rows.mapInArrow(deal, "part int, guard int, id long, text binary, print string")
    order = [F.col("part"), F.col("guard"), F.col("id").desc_nulls_last(), F.sha2("text", 256)]
    laid = dealt.repartition(ranges, "part").sortWithinPartitions(*order)

    def pairs(batches):
        expand = zstandard.ZstdDecompressor()
        open_row = None  # the last row of the range, which waits for its next
        first = None
        done: list[tuple] = []

        def finish(row, following):
            text_, next_ = row[1], following[1]
            done.append((row[0], text_, edited(text_, next_), row[2], following[2]))

        def flush():
            nonlocal done
            if done:
                new = [d[2] for d in done]
                prints = packed(pa.array(new, pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d[0] for d in done], pa.int64()),
                        pa.array([len(d[1]) for d in done], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
                        pa.array([d[3] for d in done]),
                        pa.array(prints),
                        pa.array([likeness(d[3], p) for d, p in zip(done, prints)], pa.float64()),
                        pa.array([likeness(d[3], d[4]) for d in done], pa.float64()),
                    ],
                    ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
                done = []

        part = None
        for batch in batches:
            for at in range(len(batch)):
                p, guard = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                if p != part:
                    if open_row is not None:
                        finish(open_row, first)
                    part, open_row, first = p, None, None
                if guard and open_row is None:
                    continue  # a further guard: the first has served
                text_ = expand.decompress(batch.column(3)[at].as_py()).decode() if len(batch.column(3)[at].as_py()) else ""
                row = (batch.column(2)[at].as_py(), text_, batch.column(4)[at].as_py())
                if open_row is not None:
                    finish(open_row, row)
                open_row = None if guard else row
                first = first or row
                if len(done) >= 200:
                    yield from flush()
        if open_row is not None:
            finish(open_row, first)
        yield from flush()

    schema = (
        "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    out = laid.mapInArrow(pairs, schema)
    return out.withColumn("id", F.col("id").cast(docs.schema[id].dataType)).withColumnRenamed("id", id)
