"""Words and word windows of many texts at once, as NumPy arrays over Arrow buffers.

Both word rules used by the operators split at bytes below 128 only, so texts are
cut as UTF-8 bytes; no text is decoded. Work goes through chunks of about one
megabyte, so memory does not grow with the size of an Arrow batch.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Tasks get these helpers by value, so workers need no copy of the package. Broadcasts are
# pickled by reference: they hold plain values, arrays and dictionaries (``plain``) only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def plain(thing) -> dict:
    """What an object of this package holds, to broadcast."""
    return dict(vars(thing))


def rebuilt(kind: type, state: dict):
    """The object again, in a task; arrays are shared with ``state``, not copied."""
    thing = kind.__new__(kind)
    thing.__dict__.update(state)
    return thing

CHUNK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
STEP = np.uint64(0xD1342543DE82EF95)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, bool)  # what is left after 00-2F, 3A-60 and 7B-7F, upper case lowered
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[9:14] = NOT_SPACE[32] = False

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n, modulo 2**64."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, CHUNK_BYTES + (1 << 18))
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of several texts: byte ranges, 64-bit hashes, and each text's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, allowed: np.ndarray):
        self.data = data = LOWER[data]
        n = len(data)
        inside = allowed[data]
        edge = np.ones(n + 1, bool)
        np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
        edge[offsets] = True
        self.begin = np.flatnonzero(inside & edge[:n])
        self.end = np.flatnonzero(inside & edge[1:]) + 1
        self.first = np.searchsorted(self.begin, offsets)  # words before each text's first byte
        self.offsets = offsets
        self.total: np.ndarray | None = None

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return self.hashes_of(self.begin, self.end)

    def hashes_of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; equal bytes have equal hashes."""
        up, down = powers(len(self.data))
        if self.total is None:
            self.total = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=self.total[1:])
        return mix((self.total[end] - self.total[begin]) * down[begin])

    def bytes_of(self, i: int, k: int) -> bytes:
        """Words i to i + k - 1, joined by a space."""
        return b" ".join(self.data[b:e].tobytes() for b, e in zip(self.begin[i : i + k], self.end[i : i + k]))


def windows(hashes: np.ndarray, first: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start word, hash and text of every run of ``k`` words within one text.

    With ``short``, a text of fewer words, but not none, gives one window of all
    its words. Hashes of windows of different lengths differ.
    """
    count = np.diff(first)
    number = np.maximum(count - k + 1, 0)
    if short:
        number = np.where((count > 0) & (count < k), 1, number)
    text = np.repeat(np.arange(len(count)), number)
    start = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(first[:-1], number)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    size = np.full(len(text), k, np.uint64)
    few = np.flatnonzero(count[text] < k) if short else np.zeros(0, int)
    total = np.zeros(len(text), np.uint64)
    factor = STEP
    for j in range(k):
        word = padded[start + j]
        if len(few):
            word[few[j >= count[text[few]]]] = 0
        total += word * factor
        factor = np.uint64(int(factor) * int(STEP) % (1 << 64))
    if len(few):
        size[few] = count[text[few]]
    return start, mix(total + size), text


def occurrences(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Rank of every hash among the equal ones of its text, in text order, from 0."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    starts = np.flatnonzero(new)
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    return rank


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows a to b - 1 with their bytes and offsets, about ``most`` bytes at a time, whole texts only."""
    if not len(column):
        return
    data, offsets = buffers(column)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
