"""Near duplicates by order MinHash, candidates verified by banded alignment.

Shingles are runs of five words (letters, digits and characters from 128 on, A-Z
lowered; a text of fewer words, but not none, is one shingle). Every shingle carries its
occurrence number in its text, so all shingles of a text differ. A sketch value
keeps, for one hash function, the ``KEPT`` shingles with the least hashes, in text
order; two texts share it if they share these shingles and their order. Bands of
``ROWS`` sketch values are the candidate keys.

Two texts are near if an alignment of their shingle sequences matches m of them
with m / (n1 + n2 - m) >= ``similarity``. As shingles of a text differ, the best
alignment is a longest increasing subsequence, searched in the band of diagonals
that an alignment good enough cannot leave. A class is a connected component of
near links and exact copies; its id is its least document id.

With the defaults a pair of similarity 0.8 shares no band with a chance of 1e-4.

The texts of a bucket are compared with its leader, the member that meets most other texts.
Where not all end up in one class, a bucket of at most ``SMALL`` texts is compared pair
by pair. The members of larger ones form crowds, one for each class of leaders. In a crowd
all pairs of different classes are compared, in cells of two blocks of texts; shingles in
common are counted first, which is exact as an alignment matches no more than these.
So every pair of texts that share a bucket is compared or known to be of one class. Groups
of thousands of near copies cost a star of links each; texts outside the class of their
crowd's leader are compared with the whole crowd, so a crowd just below the threshold costs the
square of its texts in counting, not in rows.

Defined results: a NULL text is near nothing, so it is its own class; texts without words
are near only to equal texts; repeated rows share a class; NULL ids are allowed (a
class of rows without ids has a NULL id); other columns are kept or not read. Empty
tables give empty results. Equal texts are told by a 64-bit hash.
"""

from __future__ import annotations

import sys
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.components import components, tasks_for
from tallyflow.llm.text import ALNUM, Words, chunks, mix, occurrences, windows
from tallyflow.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS, KEPT = 30, 2, 3
SMALL = 8
PAIRS_A_TASK = 500
BROADCAST_NODES = 1_000_000  # 8 MB
BLOCK_SHINGLES = 100_000  # of the texts in one block of a crowd, about
SKETCHED_BYTES = 1 << 18  # of texts sketched together, about
POOL = 24.0  # expected shingles below the threshold of the quick search


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles with their occurrence number, and each text's range of them."""
    _, values, text = windows(words.hashes(), words.first, width, True)
    values = mix(values + occurrences(values, text).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    return values, np.searchsorted(text, np.arange(len(words.first)))


def sketch(values: np.ndarray, first: np.ndarray, seeds: np.ndarray, kept: int) -> np.ndarray:
    """One row per text, one 32-bit sketch value per seed; a text without shingles has zeros."""
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    share = np.minimum(POOL / np.maximum(count, 1), 1.0)
    limit = np.where(share < 1, share * 2.0**63, 2.0**63 - 1).astype(np.uint64)[text]
    want = np.minimum(count, kept)
    out = np.zeros((len(count), len(seeds)), np.uint32)
    everything = np.arange(len(values))
    for s, seed in enumerate(seeds):
        hashed = (values * seed) >> np.uint64(1)
        picked = np.flatnonzero(hashed <= limit)
        got = np.bincount(text[picked], minlength=len(count))
        if (got < want).any():  # too few below the threshold: take all shingles of these texts
            picked = everything[(hashed <= limit) | (got < want)[text]]
            got = np.bincount(text[picked], minlength=len(count))
        order = picked[np.lexsort((hashed[picked], text[picked]))]
        rank = np.arange(len(order)) - np.repeat(np.cumsum(got) - got, got)
        best = np.sort(order[rank < kept])  # back in text order
        total = np.zeros(len(count), np.uint64)
        place = np.arange(len(best)) - np.repeat(np.cumsum(want) - want, want)
        for j in range(kept):
            at = best[place == j]
            total[text[at]] = mix(total[text[at]] + values[at] + np.uint64(j + 1))
        out[:, s] = (total >> np.uint64(32)).astype(np.uint32)
    return out


def aligned(a: np.ndarray, b: np.ndarray, need: int) -> int:
    """Shingles matched by the best alignment, exact where it is ``need`` or more."""
    order = np.argsort(a)
    at = np.minimum(np.searchsorted(a, b, sorter=order), len(a) - 1)
    where = order[at]
    inside = np.flatnonzero(a[where] == b)
    where = where[inside]
    band = len(a) + len(b) - 2 * need
    where = where[np.abs(where - inside) <= band]
    if len(where) < need or np.all(where[1:] > where[:-1]):
        return len(where)
    tails: list[int] = []
    for x in where.tolist():
        i = bisect_left(tails, x)
        if i == len(tails):
            tails.append(x)
        else:
            tails[i] = x
    return len(tails)


def needed(n: int, similarity: float) -> int:
    """Least number of matches of two texts with ``n`` shingles together."""
    return max(1, int(np.ceil(similarity / (1 + similarity) * n - 1e-9)))


def text_key(text: str) -> Column:
    """The node of a text; NULL has none."""
    return F.when(F.col(text).isNotNull(), F.xxhash64(text))


def _sketches(docs: DataFrame, text: str, width: int) -> DataFrame:
    seeds = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1), SKETCHED_BYTES):
                values, first = shingles(Words(data, offsets, ALNUM), width)
                signs = sketch(values, first, seeds, KEPT)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(first).astype(np.int32)),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(b - a + 1, dtype=np.int32) * len(seeds)), pa.array(signs.view(np.int32).ravel())
                        ),
                    ],
                    ["node", "n", "signs"],
                )

    rows = docs.select(text_key(text).alias("node"), text).filter("node is not null")
    return (
        rows.mapInArrow(run, "node long, n int, signs array<int>")
        .filter("n > 0")
        .groupBy("node")
        .agg(F.any_value("n").alias("n"), F.any_value("signs").alias("signs"))
    )


def _members(keys: DataFrame) -> tuple[DataFrame, int]:
    """The keys that several texts share, with ``size``, ``leader`` and ``leader_n``, and tasks for tables of that size."""
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = materialize(keys.join(sizes, "key"), "shared")
    tasks = tasks_for(shared.count())
    # The text that meets most others is likely the one that the others were made from.
    met = shared.groupBy("node").agg(
        (F.sum("size") + F.pmod(F.xxhash64("node"), F.lit(1_000_003)) / F.lit(1_000_003.0)).alias("met")
    )
    met = materialize(shared.join(met.coalesce(tasks), "node").coalesce(tasks), "met")
    leaders = met.groupBy("key").agg(F.max_by("node", "met").alias("leader"), F.max_by("n", "met").alias("leader_n"))
    return materialize(met.drop("met").join(leaders.coalesce(tasks), "key").coalesce(tasks), "members"), tasks


def _pairs(rows: DataFrame, one: str, two: str) -> DataFrame:
    """Pairs ``a > b`` of two node columns, each once, with the number of rows that name it."""
    return rows.groupBy(F.greatest(one, two).alias("a"), F.least(one, two).alias("b")).agg(F.count(F.lit(1)).alias("shared"))


def _verify(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs that are near."""

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(2)):
                rows = batch.slice(i, j - i)
                left, lf = shingles(Words(data, offsets, ALNUM), width)
                good = []
                for p, q, data2, offsets2 in chunks(rows.column(3)):
                    right, rf = shingles(Words(data2, offsets2, ALNUM), width)
                    for k in range(p, q):
                        x, y = left[lf[k] : lf[k + 1]], right[rf[k - p] : rf[k - p + 1]]
                        need = needed(len(x) + len(y), similarity)
                        good.append(min(len(x), len(y)) >= need and aligned(x, y, need) >= need)
                yield rows.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = materialize(pairs.select("a", "b"), "todo")
    tasks = tasks_for(pairs.count(), PAIRS_A_TASK)
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").coalesce(tasks)
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").coalesce(tasks)
    return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "near")


def _rooted(rows: DataFrame, roots: DataFrame, columns: list[str], tasks: int) -> DataFrame:
    """``rows`` with the component of each of some node columns as ``root_<column>``."""
    for c in columns:
        named = roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        rows = rows.join(named, c, "left").coalesce(tasks).withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
    return rows


def _texts(docs: DataFrame, text: str, nodes: DataFrame) -> DataFrame:
    """The text of every node in ``nodes``, once."""
    texts = docs.select(text_key(text).alias("node"), F.col(text).alias("text")).filter("node is not null")
    nodes = materialize(nodes.distinct(), "nodes")
    few = nodes.count() <= BROADCAST_NODES  # above that, texts are shuffled to their nodes
    wanted = texts.join(F.broadcast(nodes) if few else nodes, "node", "left_semi")
    return materialize(wanted.groupBy("node").agg(F.any_value("text").alias("text")), "texts")


def _crowds(members: DataFrame, roots: DataFrame, tasks: int) -> DataFrame:
    """``crowd, node, n, root`` of the members of buckets too large for all pairs, where a crowd has several classes."""
    large = _rooted(members.filter(f"size > {SMALL}").select("key", "node", "n", "leader"), roots, ["node", "leader"], tasks)
    mixed = large.filter("root_node <> root_leader").select("key").distinct().coalesce(tasks)
    large = large.join(mixed, "key", "left_semi").coalesce(tasks)
    return materialize(
        large.select(F.col("root_leader").alias("crowd"), "node", "n", F.col("root_node").alias("root")).distinct().coalesce(tasks), "crowds"
    )


def _compared(crowds: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The near pairs of different classes in every crowd, as far as they connect classes.

    Members outside the leader's class meet each other and all of that class, which need not
    meet itself: blocks 0 to p - 1 hold the class, blocks p to p + q - 1 the others.
    """
    outside = F.col("root") != F.col("crowd")
    weight = lambda chosen: F.ceil(F.sum(F.when(chosen, F.col("n")).otherwise(0)) / F.lit(BLOCK_SHINGLES))
    sizes = crowds.groupBy("crowd").agg(weight(~outside).alias("p"), weight(outside).alias("q"))
    spread = F.xxhash64("node")
    block = F.when(outside, F.col("p") + F.pmod(spread, F.col("q"))).otherwise(F.pmod(spread, F.greatest("p", F.lit(1))))
    blocks = crowds.join(F.broadcast(sizes), "crowd").withColumn("block", block).withColumn("last", F.col("p") + F.col("q") - 1)
    cell = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    here = F.col("block")
    after = F.transform(F.sequence(F.greatest("block", "p"), F.col("last")), lambda y: cell(here, y))
    # Cells left of the diagonal only for blocks that are in the second place.
    before = F.when(outside & (here > 0), F.transform(F.sequence(F.lit(0).cast("long"), here - 1), lambda x: cell(x, here)))
    cells = blocks.withColumn("cell", F.explode(F.concat(after, F.coalesce(before, F.array().cast("array<struct<x:bigint,y:bigint>>")))))
    cells = cells.select("crowd", "cell.x", "cell.y", "block", "node", "root")
    rows = cells.join(texts, "node")

    def run(table):
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        block = table.column("block").to_numpy()
        sides = []
        for at in (x, y)[: 1 if x == y else 2]:
            part = table.filter(pa.array(block == at))
            values, first = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
            for _, _, data, offsets in chunks(part.column("text")):
                v, f = shingles(Words(data, offsets, ALNUM), width)
                first.append(f[1:] + first[-1][-1])
                values.append(v)
            sides.append((part.column("node").to_pylist(), part.column("root").to_pylist(), np.concatenate(values), np.concatenate(first)))
        a, b = block_links(sides[0], sides[-1], x == y, similarity)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return materialize(rows.groupBy("crowd", "x", "y").applyInArrow(run, "a long, b long").distinct(), "near")


def block_links(one, two, same: bool, similarity: float) -> tuple[list[int], list[int]]:
    """Near pairs (nodes) between two blocks that connect all classes which near pairs connect.

    A block is its nodes, their classes, the shingles of all its texts and where each text's begin.
    """
    nodes, roots, values, first = one
    nodes2, roots2, values2, first2 = two
    parent = {r: r for r in (*roots, *roots2)}

    def find(r):
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    size2 = np.diff(first2)
    order = np.argsort(values2, kind="stable")
    held, owner = values2[order], np.repeat(np.arange(len(nodes2)), size2)[order]
    known = np.array(roots2, np.int64)
    a, b = [], []
    for k, node in enumerate(nodes):
        x = values[first[k] : first[k + 1]]
        low = np.searchsorted(held, x, "left")
        many = np.searchsorted(held, x, "right") - low
        total = int(many.sum())
        if not total or (known == roots[k]).all():
            continue
        at = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        common = np.bincount(owner[at], minlength=len(nodes2))
        need = np.maximum(1, np.ceil(similarity / (1 + similarity) * (len(x) + size2) - 1e-9)).astype(np.int64)
        enough = (common >= need) & (known != roots[k])
        if same:
            enough[: k + 1] = False
        for j in np.flatnonzero(enough).tolist():
            left, right = find(roots[k]), find(roots2[j])
            if left != right and aligned(x, values2[first2[j] : first2[j + 1]], int(need[j])) >= need[j]:
                parent[left] = right
                a.append(max(node, nodes2[j]))
                b.append(min(node, nodes2[j]))
    return a, b


def near_links(docs: DataFrame, text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``node, root`` for every text (by its hash) that is near another text."""
    spark = docs.sparkSession
    signs = materialize(_sketches(docs, text, width), "signs")
    band = lambda j: F.xxhash64(F.lit(j), *[F.col("signs")[j * ROWS + r] for r in range(ROWS)])
    fits = lambda a, b: F.least(a, b) >= F.lit(similarity) * F.greatest(a, b)
    keys = signs.select("node", "n", F.explode(F.array(*[band(j) for j in range(BANDS)])).alias("key"))
    # Not from a Python list: that starts another pair of Python workers in every executor.
    none = F.col("id")
    links = spark.range(0).select(none.alias("a"), none.alias("b"))
    roots = spark.range(0).select(none.alias("node"), none.alias("root"))
    members, tasks = _members(keys)
    texts = _texts(docs, text, members.select("node"))
    star = members.filter("node <> leader").filter(fits("n", "leader_n"))
    pairs = materialize(_pairs(star, "node", "leader").coalesce(tasks), "pairs")
    # The likeliest partner of every text comes first; most other pairs are then within one component.
    best = pairs.groupBy("a").agg(F.max_by("b", "shared").alias("b")).coalesce(tasks)
    for part in ("best", "rest", "crowds"):
        if part == "best":
            found = _verify(best, texts, width, similarity)
        elif part == "rest":
            todo = _rooted(pairs.join(best, ["a", "b"], "left_anti").coalesce(tasks), roots, ["a", "b"], tasks)
            todo = todo.filter("root_a <> root_b").select("a", "b")
            placed = materialize(_rooted(members, roots, ["node", "leader"], tasks), "placed")
            # Small buckets of several components: all pairs of different components.
            small = placed.filter(f"size between 3 and {SMALL}")
            mixed = small.filter("root_node <> root_leader").select("key").distinct().coalesce(tasks)
            small = small.join(mixed, "key", "left_semi").coalesce(tasks).select("key", "node", "n", "root_node", "leader")
            other = small.select("key", F.col("node").alias("o"), F.col("n").alias("o_n"), F.col("root_node").alias("root_o"))
            close = small.join(other, "key").coalesce(tasks).filter("node < o and root_node <> root_o and node <> leader and o <> leader")
            close = _pairs(close.filter(fits("n", "o_n")), "node", "o").coalesce(tasks)
            found = _verify(todo.union(close.select("a", "b")).distinct().coalesce(tasks), texts, width, similarity)
        else:
            crowds = _crowds(members, roots, tasks)
            if crowds.isEmpty():
                break
            found = _compared(crowds, texts, width, similarity)
        if not found.isEmpty():
            links = materialize(links.union(found), "near")
            roots = materialize(components(links), "roots")
    return roots


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY
) -> DataFrame:
    """One row per document: ``id``, ``class_id`` (least id of its class), ``class_size`` (documents)."""
    roots = near_links(docs, text, width, similarity)
    rows = docs.select(F.col(id).alias("id"), text_key(text).alias("node"))
    groups = rows.filter("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("many"))
    groups = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = groups.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("many").alias("class_size"))
    named = groups.join(classes, "root").select("node", "class_id", "class_size")
    out = rows.join(named, "node", "left")
    return out.select(
        F.col("id").alias(id),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
    )


def drop_near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY
) -> DataFrame:
    """One document of every class, the one with the least id; same columns."""
    roots = near_links(docs, text, width, similarity)
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id).alias("id"), text_key(text).alias("node"))
    groups = rows.filter("node is not null").groupBy("node").agg(F.min(F.struct(F.col("id").isNull(), "id")).alias("least"))
    groups = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    chosen = materialize(
        groups.groupBy("root").agg(F.min(F.struct("least", "node")).alias("kept")).select("kept.node", "kept.least.id"), "kept"
    )
    same = rows["id"].eqNullSafe(chosen["id"]) & (rows["node"] == chosen["node"])
    kept = rows.join(chosen, same, "left_semi")
    # Rows that repeat a kept row's id and text are copies too.
    twice = materialize(kept.groupBy("id", "node").count().filter("count > 1").select("id", "node"), "repeated")
    if not twice.isEmpty():
        repeated = kept["id"].eqNullSafe(twice["id"]) & (kept["node"] == twice["node"])
        one = kept.join(twice, repeated, "left_semi").groupBy("id", "node").agg(F.any_value("row").alias("row"))
        kept = kept.join(twice, repeated, "left_anti").select("row").union(one.select("row"))
    return kept.select("row").union(rows.filter("node is null").select("row")).select("row.*")
