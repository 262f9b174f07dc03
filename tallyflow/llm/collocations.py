"""Phrase collocations by best-first branch and bound over prefixes.

A candidate is a run of 2 to 4 words inside a piece (text between stops) that occurs often enough.
Its score is the lowest, over its cuts, of 2,000,000 a / (l + r): a counts the phrase, l and r its two
parts. A phrase is never more frequent than its prefix p, and r is never less than a, so nothing that
grows from p scores more than

    least over the prefixes s of p, itself included, of 2,000,000 f(p) / (f(s) + f(p)).

Words bound nothing, so the frontier starts with all pairs of frequent words. A round takes, for
every language, the prefixes whose bound reaches a score ``floor``, best first: it scans the texts and
counts what grows from them, three words, then four. Everything that scores the floor or more is
then known. A candidate is dropped if one word more before or behind it keeps 80 % of its count (longer
phrases are never more frequent, so one word decides); to see this, phrases *ending* in a
candidate are counted too. Once the survivors at or above the floor are as many as asked for, the last
place, ties included, is settled: what is left in the frontier scores less. Otherwise the floor sinks
to the score of twice as many candidates, and at last to 0.

Scans work on words as 64-bit hashes over Arrow buffers; a phrase is the tuple of its word hashes, so
phrases are never confused if words are not. A hash shared by two words of which one could be
frequent shows in the count of words, and all hashes are drawn anew from another seed. Frontiers, suffixes and frequent parts
go to the tasks as bitmaps of fixed size: two prefixes in one bit only make a scan count more, never less.

Defined results: NULL texts are empty, a NULL language is ``und``; repeated rows count each time; other
columns are not read; an empty table gives no rows. A text may be one word of any length.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm.text import Words, chunks, mix
from tallyflow.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LONGEST = 4
LEAST = 30
TOP = 2000
MILLIONS = 2_000_000
KEPT = 80  # per cent of its count that a longer phrase keeps to drop a candidate
BITS = 25  # of a bitmap's size
BUCKET = 1 << 15  # bits of one stored part of a bitmap
TURN = 17  # bits by which the hash of each further word is rotated
HELD = 1 << 21  # phrases that a task holds before it adds up
WORDS_HELD = 1 << 19

WORD = np.ones(256, bool)
WORD[9:14] = WORD[32] = False
BREAK = np.zeros(256, bool)
BREAK[10:14] = True
for _stop in b".,;:!?":
    WORD[_stop], BREAK[_stop] = False, True


# ---- inside tasks ----


def _salts(lang: pa.Array, seed: int) -> np.ndarray:
    """One 64-bit number per row, by language."""
    coded = lang.dictionary_encode()
    known = [int.from_bytes(blake2b(f"{seed}:{x}".encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()]
    return np.array(known, np.uint64)[coded.indices.to_numpy(zero_copy_only=False)] if known else np.zeros(0, np.uint64)


def _read(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[Words, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of a batch, chunk by chunk: their hashes, their texts, and whether the next word follows in the same piece."""
    salts = _salts(batch.column("lang"), seed)
    for a, _, data, offsets in chunks(batch.column("text")):
        words = Words(data, offsets, WORD)
        text = np.repeat(np.arange(len(offsets) - 1), words.count)
        hashes = mix(words.hashes() + salts[a + text])
        piece = np.cumsum(BREAK[data], dtype=np.int64)
        piece = piece[words.begin] if len(words.begin) else piece[:0]
        follows = np.zeros(len(hashes), bool)
        follows[:-1] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
        yield words, hashes, a + text, follows


def _slot(columns: list[np.ndarray]) -> np.ndarray:
    """Exclusive or of the hashes, each further one rotated further; ``_slot_column`` is its SQL form."""
    total = columns[0].copy()
    for i, c in enumerate(columns[1:], 1):
        total ^= (c << np.uint64(TURN * i)) | (c >> np.uint64(64 - TURN * i))
    return total


def _in(bitmap: np.ndarray, slot: np.ndarray) -> np.ndarray:
    place = slot & np.uint64((1 << BITS) - 1)
    return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


class Tally:
    """Adds up phrases of one length; what it holds is bounded."""

    def __init__(self, length: int):
        self.length, self.parts, self.held = length, [], 0

    def add(self, columns: list[np.ndarray]) -> None:
        if len(columns[0]):
            self.parts.append((*columns, np.ones(len(columns[0]), np.int64)))
            self.held += len(columns[0])

    def summed(self) -> list[np.ndarray]:
        """Distinct phrases and their counts."""
        *columns, n = [np.concatenate(c) for c in zip(*self.parts)] if self.parts else [np.zeros(0, np.uint64)] * self.length + [np.zeros(0, np.int64)]
        key = _slot(columns)
        order = np.argsort(key, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = np.diff(key[order]) != 0
        if any((np.diff(c[order])[~new[1:]] != 0).any() for c in columns):  # two phrases with one key
            order = np.lexsort(columns)
            new[1:] = np.logical_or.reduce([np.diff(c[order]) != 0 for c in columns])
        starts = np.flatnonzero(new)
        out = [c[order[starts]] for c in columns]
        out.append(np.add.reduceat(n[order], starts) if len(starts) else n)
        self.parts, self.held = [tuple(out)], len(starts)
        return out

    def flush(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if not (last or self.held > HELD):
            return
        out = self.summed()
        if last or self.held > HELD // 2:
            self.parts, self.held = [], 0
            empty = np.zeros(len(out[0]), np.int64)
            arrays = [pa.array(c.view(np.int64)) for c in out[:-1]] + [pa.array(empty)] * (LONGEST - self.length)
            if len(empty):
                yield pa.RecordBatch.from_arrays([pa.array(empty + self.length), *arrays, pa.array(out[-1])], ["size", *HASHES, "a"])


HASHES = [f"h{i}" for i in range(1, LONGEST + 1)]
_COUNTED = "size long, " + ", ".join(f"{h} long" for h in HASHES) + ", a long"


def _bits(parts: list[tuple[int, bytes]]) -> np.ndarray:
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    for bucket, held in parts:
        bitmap[bucket * BUCKET // 8 : (bucket + 1) * BUCKET // 8] = np.frombuffer(held, np.uint8)
    return bitmap


# ---- scans ----


def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))


def _word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """Partial counts of all words: hash, language, word."""

    def run(batches):
        seen: dict[int, tuple[str, bytes]] = {}
        total: dict[int, int] = {}

        def out():
            keys = list(total)
            columns = [pa.array(keys, pa.int64()), pa.array([seen[k][0] for k in keys], pa.string())]
            columns += [pa.array([seen[k][1] for k in keys], pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())]
            seen.clear(), total.clear()
            return pa.RecordBatch.from_arrays(columns, ["h", "lang", "word", "n"])

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for words, hashes, text, _ in _read(batch, seed):
                key, first, n = np.unique(hashes.view(np.int64), return_index=True, return_counts=True)
                for k, i, c in zip(key.tolist(), first.tolist(), n.tolist()):
                    if k not in total:
                        seen[k] = langs[text[i]], words.data[words.begin[i] : words.end[i]].tobytes()
                        total[k] = c
                    else:
                        total[k] += c
                if len(total) > WORDS_HELD:
                    yield out()
        if total:
            yield out()

    return texts.mapInArrow(run, "h long, lang string, word string, n long")


def _scan(texts: DataFrame, seed: int, frequent: dict, wanted: list[tuple]) -> DataFrame:
    """Counts of phrases, at least of those that are wanted.

    ``wanted`` lists (length, bitmap of prefixes or None, bitmap of suffixes or None); with neither, all
    phrases of that length count. ``frequent`` has a bitmap of the frequent phrases of some
    lengths: a phrase with a part that is not frequent is not either.
    """
    sent = texts.sparkSession.sparkContext.broadcast((frequent, wanted))

    def run(batches):
        held, asked = sent.value
        often = {k: _bits(parts) for k, parts in held.items()}
        kinds = [(n, *(None if x is None else _bits(x) for x in sets)) for n, *sets in asked]
        tallies = {n: Tally(n) for n, *_ in kinds}
        for batch in batches:
            for _, h, _, follows in _read(batch, seed):
                longest = max(tallies)
                size = len(h)
                slots = {1: _slot([h])} if size else {}
                runs = {1: np.ones(size, bool)}
                for n in range(2, longest + 1):
                    runs[n] = np.zeros(size, bool)
                    if size >= n:
                        runs[n][: size - n + 1] = runs[n - 1][: size - n + 1] & follows[n - 2 : size - 1]
                ok = {k: runs[k] & _in(bitmap, _padded_slot(h, k)) for k, bitmap in often.items() if size}
                for n, prefixes, suffixes in kinds if size else []:
                    at = runs[n].copy()
                    for k, good in ok.items():
                        for i in range(n - k + 1):
                            at[: size - i] &= good[i:]
                            at[size - i :] = False
                    at = np.flatnonzero(at)
                    if prefixes is not None:
                        hit = _in(prefixes, _slot([h[at + i] for i in range(n - 1)]))
                        if suffixes is not None:
                            hit |= _in(suffixes, _slot([h[at + i] for i in range(1, n)]))
                        at = at[hit]
                    tallies[n].add([h[at + i] for i in range(n)])
                for tally in tallies.values():
                    yield from tally.flush()
        for tally in tallies.values():
            yield from tally.flush(last=True)

    rows = texts.mapInArrow(run, _COUNTED)
    return rows.groupBy("size", *HASHES).agg(F.sum("a").alias("a"))


def _padded_slot(h: np.ndarray, k: int) -> np.ndarray:
    """Slot of the k words from every place on; places too near the end are never asked for."""
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    return _slot([padded[i : i + len(h)] for i in range(k)])


# ---- bitmaps and bounds ----


def _slot_column(columns: list[str]) -> Column:
    total = F.col(columns[0])
    for i, name in enumerate(columns[1:], 1):
        c = F.col(name)
        total = total.bitwiseXOR(F.shiftleft(c, TURN * i).bitwiseOR(F.shiftrightunsigned(c, 64 - TURN * i)))
    return total


def _bitmap(rows: DataFrame, columns: list[str]) -> list[tuple[int, bytes]]:
    """The slots of the rows as parts of a bitmap of 2**BITS bits, whatever the number of rows."""
    slot = _slot_column(columns).bitwiseAND(F.lit((1 << BITS) - 1))
    parts = rows.select(slot.alias("slot")).groupBy(F.expr(f"slot div {BUCKET}").alias("bucket"))
    made = parts.agg(F.expr(f"bitmap_construct_agg(slot % {BUCKET})").alias("bits"))
    return [(r["bucket"], bytes(r["bits"])) for r in made.collect()]


def _exact(c: Column) -> Column:
    return c.cast("decimal(18,0)")


def _ratio(a: Column, l: Column, r: Column) -> Column:
    """floor(2,000,000 a / (l + r)) without overflow."""
    return F.call_function("div", F.lit(MILLIONS).cast("decimal(7,0)") * _exact(a), _exact(l) + _exact(r))


def _cut(cuts: list[tuple[str, str]]) -> Column:
    """Score, place, l and r of the lowest-scoring cut, the first of them."""
    kinds = [
        F.struct(_ratio(F.col("a"), F.col(l), F.col(r)).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))
        for k, (l, r) in enumerate(cuts, 1)
    ]
    return reduce(lambda x, y: F.when(y["score"] < x["score"], y).otherwise(x), kinds)


def _bound(prefixes: list[str]) -> Column:
    """Most that a phrase with this prefix can score: ``prefixes`` are counts of the prefix's own prefixes."""
    ratios = [_ratio(F.col("a"), F.col(p), F.col("a")) for p in prefixes]
    return ratios[0] if len(ratios) == 1 else F.least(*ratios)


def _counts_of(table: DataFrame, size: int, at: int, name: str) -> DataFrame:
    """Counts of parts, keyed as the words from place ``at`` on."""
    keys = [F.col(f"h{i}").alias(f"h{at + i - 1}") for i in range(1, size + 1)]
    return table.select(*keys, F.col("a").alias(name))


def _with_counts(rows: DataFrame, parts: list[tuple[DataFrame, int, int, str]], how: str = "left") -> DataFrame:
    for table, size, at, name in parts:
        rows = rows.join(_counts_of(table, size, at, name), [f"h{at + i}" for i in range(size)], how)
    return rows


# ---- the search ----


def _vocabulary(texts: DataFrame, least: int) -> tuple[int, DataFrame, DataFrame]:
    """A seed whose hashes tell frequent words apart, the frequent words, and all words per language."""
    for seed in count():
        partial = materialize(_word_counts(texts, seed), "phrase-words")
        same = (F.min("word") == F.max("word")) & (F.min("lang") == F.max("lang"))
        summed = partial.groupBy("h").agg(F.sum("n").alias("a"), F.min("word").alias("word"), F.min("lang").alias("lang"), same.alias("one"))
        words = materialize(summed.filter(F.col("a") >= least), "phrase-vocabulary")
        if words.filter(~F.col("one")).isEmpty():
            totals = partial.groupBy("lang").agg(F.sum("n").alias("n"))
            return seed, words.select(F.col("h").alias("h1"), "a", "word", "lang"), totals


def _floors(scored: DataFrame, rank: int) -> DataFrame:
    """Per language the score at a rank, 0 if there are fewer; a language has at most a million different scores."""
    by_score = scored.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("here"))
    upto = F.sum("here").over(Window.partitionBy("lang").orderBy(F.desc("score")))
    reached = by_score.withColumn("upto", upto).groupBy("lang")
    return reached.agg(F.coalesce(F.max(F.when(F.col("upto") >= rank, F.col("score"))), F.lit(0)).alias("floor"))


def _contained(longer: DataFrame, size: int) -> DataFrame:
    """Parts, one word shorter, of the longer candidates, with the largest count of one that holds them."""
    shorter = [[F.col(f"h{i + at}").alias(f"h{i}") for i in range(1, size)] for at in (0, 1)]
    parts = longer.select(*shorter[0], "a").union(longer.select(*shorter[1], "a"))
    return parts.groupBy(*HASHES[: size - 1]).agg(F.max("a").alias("longer"))


def _survivors(scored: DataFrame, longer: DataFrame | None, size: int) -> DataFrame:
    rows = scored.filter(F.col("score") >= F.col("floor"))
    if longer is not None:
        rows = rows.join(_contained(longer, size + 1), HASHES[:size], "left")
        kept = _exact(F.col("longer")) * 100 >= _exact(F.col("a")) * KEPT
        rows = rows.filter(~F.coalesce(kept, F.lit(False)))
    blank = [F.lit(0).cast("long").alias(h) for h in HASHES[size:]]
    return rows.select("lang", F.lit(size).alias("size"), *HASHES[:size], *blank, "a", "l", "r", "score")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, lang: str = "lang", text: str = "text") -> DataFrame:
    """Per language the best ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    texts = _texts(docs, lang, text)
    seed, words, totals = _vocabulary(texts, least)
    often = {1: _bitmap(words, ["h1"])}

    pairs = _scan(texts, seed, often, [(2, None, None)]).filter(F.col("a") >= least)
    pairs = materialize(pairs.select("h1", "h2", "a"), "phrase-pairs")
    known = pairs.join(words.select("h1", F.col("a").alias("p1"), "lang"), "h1")
    known = _with_counts(known, [(words, 1, 2, "s1")], "inner").withColumn("cut", _cut([("p1", "s1")]))
    known = known.select("lang", "h1", "h2", "a", "p1", "cut.score", "cut.l", "cut.r", _bound(["p1"]).alias("bound"))
    known = materialize(known, "phrase-pairs-scored")
    often = {2: _bitmap(pairs, ["h1", "h2"])}

    found: list[DataFrame] = []
    rank = top + top // 4
    floors = materialize(_floors(known, rank), "phrase-floors")
    while not floors.isEmpty():
        survivors, more = _round(texts, seed, often, words, known, floors, least)
        survivors = materialize(survivors, "phrase-survivors")
        sizes = survivors.groupBy("lang").agg(F.count(F.lit(1)).alias("there"))
        settled = floors.join(sizes, "lang", "left").withColumn("there", F.coalesce("there", F.lit(0)))
        settled = materialize(settled.withColumn("done", (F.col("there") >= top) | (F.col("floor") == 0)), "phrase-settled")
        found.append(survivors.join(settled.filter("done").select("lang"), "lang", "left_semi"))
        rank *= 2
        open_ = settled.filter("not done").select("lang", F.col("floor").alias("before"))
        lower = _floors(more.join(open_, "lang", "left_semi"), rank).join(open_, "lang")
        # a floor that many candidates share would not sink by rank alone
        sunk = F.when(F.col("floor") < F.col("before"), F.col("floor")).otherwise(F.expr("before div 2"))
        floors = materialize(lower.select("lang", sunk.alias("floor")), "phrase-floors")
    if not found:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    return _ranked(reduce(DataFrame.union, found), words, totals, top)


def _round(
    texts: DataFrame, seed: int, often: dict, words: DataFrame, known: DataFrame, floors: DataFrame, least: int
) -> tuple[DataFrame, DataFrame]:
    """Surviving candidates at or above the floors, and all scores that are known."""
    pairs = known.join(floors, "lang")
    frontier = pairs.filter("bound >= floor")
    three = _scan(texts, seed, often, [(3, _bitmap(frontier, ["h1", "h2"]), _bitmap(pairs.filter("score >= floor"), ["h1", "h2"]))])
    three = materialize(three.filter(F.col("a") >= least).select("h1", "h2", "h3", "a"), "phrase-triples")

    def scored3(rows: DataFrame) -> DataFrame:
        own = rows.join(words.select("h1", F.col("a").alias("p1"), "lang"), "h1")
        own = _with_counts(own, [(words, 1, 3, "s1"), (known, 2, 1, "p2"), (known, 2, 2, "s2")], "inner")
        own = own.withColumn("cut", _cut([("p1", "s2"), ("p2", "s1")]))
        own = own.select("lang", "h1", "h2", "h3", "a", "p1", "p2", "cut.score", "cut.l", "cut.r", _bound(["p1", "p2"]).alias("bound"))
        return own.join(floors, "lang")

    triples = materialize(scored3(three), "phrase-triples-scored")
    frontier = triples.filter("bound >= floor")
    # the last three words of a longer candidate are one of its parts, so they are counted as well
    wanted = [(4, _bitmap(frontier, HASHES[:3]), _bitmap(triples.filter("score >= floor"), HASHES[:3])), (3, _bitmap(frontier, ["h2", "h3"]), None)]
    grown = materialize(_scan(texts, seed, often, wanted).filter(F.col("a") >= least), "phrase-grown")
    four = grown.filter("size = 4").select(*HASHES, "a")
    parts = three.union(grown.filter("size = 3").select("h1", "h2", "h3", "a")).distinct()

    # a candidate with an unknown part grew from no prefix of the frontier: it scores less than the floor
    own = four.join(words.select("h1", F.col("a").alias("p1"), "lang"), "h1")
    own = _with_counts(own, [(words, 1, 4, "s1"), (known, 2, 1, "p2"), (known, 2, 3, "s2"), (parts, 3, 1, "p3"), (parts, 3, 2, "s3")], "inner")
    own = own.withColumn("cut", _cut([("p1", "s3"), ("p2", "s2"), ("p3", "s1")]))
    fours = materialize(own.select("lang", *HASHES, "a", "cut.score", "cut.l", "cut.r").join(floors, "lang"), "phrase-fours-scored")

    kept = [_survivors(pairs, three, 2), _survivors(triples, four, 3), _survivors(fours, None, 4)]
    scores = [t.select("lang", "score") for t in (known, triples, fours)]
    return reduce(DataFrame.union, kept), reduce(DataFrame.union, scores)


def _ranked(found: DataFrame, words: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of every language with their words."""
    cut = _floors(found, top)
    rows = found.join(cut, "lang").filter(F.col("score") >= F.col("floor")).drop("floor")
    for i in range(1, LONGEST + 1):
        named = words.select(F.col("h1").alias(f"h{i}"), F.col("word").alias(f"w{i}"))
        rows = rows.join(named, f"h{i}", "left")  # the second to last may be missing
    said = [F.when(F.col("size") >= i, F.col(f"w{i}")) for i in range(1, LONGEST + 1)]
    rows = rows.select("lang", F.concat_ws(" ", *said).alias("phrase"), "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # ties at the last place may be many: slices first, then what is left of them
    sliced = Window.partitionBy("lang", F.xxhash64("phrase") % 64).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(sliced)).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    rows = rows.join(totals, "lang")
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
