"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned by every text.

Benchmark texts are normalised (A-Z lowered, words of letters, digits and all
characters from 128 on) and cut into windows of ``width`` words; a text of fewer
words is one window. The windows' hashes go to every task in blocks of at most
``block_words`` window words, so what is broadcast is bounded; a larger benchmark is
scanned block by block and the hits of a document are united. A task looks up the
hash of every window of its documents and compares the words of each hit, so a
hash collision changes nothing.

Defined results: a NULL or empty text has no words and no hits; a benchmark item
without words has no window; an item with a NULL id marks words but is not among
the items; items with equal ids count once; repeated document rows each get a row;
other columns are not read. Empty tables give empty results, or no hits.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.llm.text import ALNUM, Words, chunks, plain, rebuilt, windows
from tallyflow.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 13
BLOCK_WORDS = 8_000_000
REPORT = (
    "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
)
#: A document is contaminated if at least one word in SHARE of its words is hit.
SHARE = 20


class Block:
    """Windows of some benchmark items: sorted hashes by length, their words and items."""

    def __init__(self, width: int):
        self.width = width
        self.found: dict[int, dict[int, dict[bytes, set[str]]]] = {}
        self.words = 0

    def add(self, item: str | None, text: str | None) -> None:
        for _, _, data, offsets in chunks(pa.array([text], pa.string())):
            words = Words(data, offsets, ALNUM)
            n = len(words.begin)
            length = min(self.width, n)
            if not n:
                continue
            starts, hashes, _ = windows(words.hashes(), words.first, length, False)
            for start, value in zip(starts.tolist(), hashes.tolist()):
                items = self.found.setdefault(length, {}).setdefault(value, {}).setdefault(words.bytes_of(start, length), set())
                if item is not None:
                    items.add(item)
                self.words += length

    def close(self) -> Block:
        self.sorted = {k: np.sort(np.fromiter(v, np.uint64, len(v))) for k, v in self.found.items()}
        self.filter = {}
        for k, values in self.sorted.items():  # one bit for every hash prefix: most windows end here
            bits = np.zeros(1 << 20, bool)
            bits[values >> np.uint64(44)] = True
            self.filter[k] = bits
        return self

    def scan(self, words: Words) -> tuple[np.ndarray, list[set[str]]]:
        """Which words lie in a window, and the items found in each text."""
        hashes = words.hashes()
        depth = np.zeros(len(hashes) + 1, np.int64)
        items: list[set[str]] = [set() for _ in range(len(words.first) - 1)]
        for k, known in self.sorted.items():
            starts, values, text = windows(hashes, words.first, k, False)
            maybe = np.flatnonzero(self.filter[k][values >> np.uint64(44)])
            at = np.searchsorted(known, values[maybe])
            maybe = maybe[known[np.minimum(at, len(known) - 1)] == values[maybe]]
            for i in maybe.tolist():
                start = int(starts[i])
                found = self.found[k][int(values[i])].get(words.bytes_of(start, k))
                if found is not None:
                    depth[start] += 1
                    depth[start + k] -= 1
                    items[text[i]] |= found
        return np.cumsum(depth[:-1]) > 0, items


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, width: int, block_words: int) -> Iterator[Block]:
    """The benchmark as closed blocks, one at a time in the driver; at least one."""
    block = Block(width)
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    for row in rows.toLocalIterator():
        block.add(row["item"], row["text"])
        if block.words >= block_words:
            yield block.close()
            block = Block(width)
    if block.words:
        yield block.close()


def _broadcast(docs: DataFrame, block: Block) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(plain(block))


def _ranges(hit: np.ndarray) -> np.ndarray:
    """First and one past the last word of every run of hit words."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _verdict(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and SHARE * n_hit >= n_words


def _united(rows: DataFrame, blocks: list[Broadcast]) -> DataFrame:
    """``row, n_words, ranges, items`` of rows ``(row, text)`` over several blocks, scanned one after the other.

    A task holds one block; the ranges of hit words and the items of a row are united by its number.
    """
    parts = None
    for block in blocks:

        def scan(batches, block=block):
            held = rebuilt(Block, block.value)
            for batch in batches:
                for a, b, data, offsets in chunks(batch.column(1)):
                    words = Words(data, offsets, ALNUM)
                    hit, items = held.scan(words)
                    ranges = [_ranges(hit[f:g]).tolist() for f, g in zip(words.first[:-1], words.first[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(a, b - a),
                            pa.array(words.count.astype(np.int64)),
                            pa.array(ranges, pa.list_(pa.list_(pa.int64()))),
                            pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                        ],
                        ["row", "n_words", "ranges", "items"],
                    )

        part = rows.mapInArrow(scan, "row long, n_words long, ranges array<array<bigint>>, items array<string>")
        part = materialize(part, "block")
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("row").agg(
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("ranges")).alias("ranges"),
        F.flatten(F.collect_set("items")).alias("items"),
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: ``id`` and the columns of REPORT."""
    blocks = [_broadcast(docs, b) for b in benchmark_blocks(benchmark, item, item_text, width, block_words)]
    if not blocks:
        blocks = [_broadcast(docs, Block(width).close())]
    kind = docs.schema[id].dataType.simpleString()
    if len(blocks) == 1:
        only = blocks[0]

        def report(batches):
            held = rebuilt(Block, only.value)
            for batch in batches:
                for a, b, data, offsets in chunks(batch.column(1)):
                    words = Words(data, offsets, ALNUM)
                    hit, items = held.scan(words)
                    total = np.concatenate([[0], np.cumsum(hit)])
                    n_hit = total[words.first[1:]] - total[words.first[:-1]]
                    count = words.count
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(a, b - a),
                            pa.array(count.astype(np.int64)),
                            pa.array(n_hit.astype(np.int64)),
                            pa.array([len(x) for x in items], pa.int64()),
                            pa.array([_digest(x) for x in items]),
                            pa.array((n_hit > 0) & (SHARE * n_hit >= count)),
                        ],
                        ["id", *[c.split()[0] for c in REPORT.split(", ")]],
                    )

        return docs.select(F.col(id).alias("id"), text).mapInArrow(report, f"id {kind}, {REPORT}").withColumnRenamed("id", id)
    numbered = materialize(docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")), "numbered")
    united = _united(numbered.select("row", "text"), blocks).join(numbered.select("row", "id"), "row")

    def unite(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                hit = np.zeros(row["n_words"], bool)
                for begin, end in row["ranges"]:
                    hit[begin:end] = True
                items, n_hit = set(row["items"]), int(hit.sum())
                rows.append((row["id"], row["n_words"], n_hit, len(items), _digest(items), _verdict(row["n_words"], n_hit)))
            names = ["id", *[c.split()[0] for c in REPORT.split(", ")]]
            types = [batch.schema.field("id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(6)], names)

    return united.mapInArrow(unite, f"id {kind}, {REPORT}").withColumnRenamed("id", id)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    mode: str = "documents",
    item: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents without what the benchmark holds; same columns.

    ``documents`` drops contaminated documents and leaves the others as they are;
    ``spans`` keeps every document and cuts each run of hit words, from its first
    to its last character, out of the text. A document is judged by all blocks
    together; a task holds one of them.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode is documents or spans")
    blocks = [_broadcast(docs, b) for b in benchmark_blocks(benchmark, item, item_text, width, block_words)]
    schema, place = docs.schema, docs.columns.index(text)

    def cleaned(part, words: Words, offsets, hit):
        total = np.concatenate([[0], np.cumsum(hit)])
        n_hit = total[words.first[1:]] - total[words.first[:-1]]
        if mode == "documents":
            return part.filter(pa.array(~((n_hit > 0) & (SHARE * n_hit >= words.count))))
        texts = part.column(place).to_pylist()
        for i in np.flatnonzero(n_hit).tolist():
            f, raw, kept, last = words.first[i], texts[i].encode(), [], 0
            for begin, end in _ranges(hit[f : words.first[i + 1]]).tolist():
                kept.append(raw[last : words.begin[f + begin] - offsets[i]])
                last = words.end[f + end - 1] - offsets[i]
            texts[i] = b"".join([*kept, raw[last:]]).decode()
        columns = list(part.columns)
        columns[place] = pa.array(texts, part.schema.field(place).type)
        return pa.RecordBatch.from_arrays(columns, schema=part.schema)

    def clean(batches):
        held = rebuilt(Block, blocks[0].value) if blocks else None
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(place)):
                words = Words(data, offsets, ALNUM)
                hit = held.scan(words)[0] if held else np.zeros(len(words.begin), bool)
                yield cleaned(batch.slice(a, b - a), words, offsets, hit)

    if len(blocks) <= 1:
        return docs.mapInArrow(clean, schema)

    def clean_ranges(batches):
        for batch in batches:
            held = batch.column(len(schema)).to_pylist()
            rows = batch.select(list(range(len(schema))))
            for a, b, data, offsets in chunks(rows.column(place)):
                words = Words(data, offsets, ALNUM)
                hit = np.zeros(len(words.begin), bool)
                for i in range(a, b):
                    for begin, end in held[i] or []:
                        hit[words.first[i - a] + begin : words.first[i - a] + end] = True
                yield cleaned(rows.slice(a, b - a), words, offsets, hit)

    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    numbered = materialize(docs.select(*named, F.monotonically_increasing_id().alias("row")), "numbered")
    united = _united(numbered.select("row", F.col(f"c{place}").alias("text")), blocks).select("row", "ranges")
    joined = numbered.join(united, "row", "left").select(*[f"c{i}" for i in range(len(schema))], "ranges")
    return joined.mapInArrow(clean_ranges, T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])).toDF(*docs.columns)
