"""Exact token counts of every prefix of a text, by prefix dynamic programming.

A byte-level BPE vocabulary cuts a text into pieces (words with their leading
space, numbers, runs of signs or of white space) and merges bytes inside a piece. For a
piece, the last token of every prefix is found from left to right: of the tokens
that end there, exactly one follows the last token of the prefix before it in a
way that the merges would keep. The count of a prefix is one more than that of the
prefix before its last token. So a piece costs one pass over its bytes, and known pieces
are looked up (``CACHE`` of them, then the table starts anew).

A text's prefixes are stored as the change of the count at each character, one byte
each. Sums of changes are the counts, which answer how many tokens the first n
characters take and how many characters fit a budget, without tokenising again.

A prefix counts as the library would count it standing alone: white space before a word,
cut contractions and cut special strings are corrected where they differ.

Defined results: NULL and empty texts have no prefixes and no tokens; repeated rows
count alike; other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 300_000
SHARED = 5
NOTHING: tuple[list[bytes], list[int]] = ([b""], [0])
LIMIT = 512
NOT_NEGATIVE = bytes(range(128))


def byte_letters() -> dict[str, int]:
    """The printable stand-ins for bytes in the vocabulary file: shown bytes stand for themselves, others follow 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges of one vocabulary file, and counts of pieces and texts."""

    def __init__(self, definition: str):
        import regex

        parsed = json.loads(definition)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.rank = {}
        for i, pair in enumerate(parsed["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((raw(a), raw(b)), i)
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in self.rank}
        self.longest = max(map(len, self.tokens))
        self.special = [t["content"] for t in parsed["added_tokens"]]
        self.pieces = regex.compile(PIECE)
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.keeps: dict[tuple[bytes, bytes], bool] = {}
        self.known: dict[str, bytes] = {}
        self.begun: dict[bytes, tuple[list[bytes], list[int]]] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Tokens of a short byte string by applying merges in order."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank, never = self.rank, 1 << 60
        ranks = [rank.get(pair, never) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == never:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank.get((parts[at], parts[at + 1]), never)
            if at:
                ranks[at - 1] = rank.get((parts[at - 1], parts[at]), never)
        return parts

    def follows(self, a: bytes, b: bytes) -> bool:
        """Whether tokens a and b stay as they are next to each other."""
        known = self.keeps.get((a, b))
        if known is None:
            if len(self.keeps) >= CACHE:
                self.keeps.clear()
            known = self.keeps[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def changes(self, piece: str) -> bytes:
        """Change of the count at every character of a piece standing alone (signed bytes)."""
        data = piece.encode()
        tokens, longest, keeps = self.tokens, self.longest, self.keeps
        # Pieces that begin alike share the rows of their first bytes.
        last, count = self.begun.get(data[:SHARED], NOTHING)
        last, count = last[:], count[:]
        for end in range(len(last), len(data) + 1):
            for begin in range(max(0, end - longest), end):
                token = data[begin:end]
                if token in tokens:
                    before = last[begin]
                    kept = keeps.get((before, token))
                    if kept or kept is None and self.follows(before, token):
                        last.append(token)
                        count.append(count[begin] + 1)
                        break
            if end == SHARED:
                if len(self.begun) >= CACHE:
                    self.begun.clear()
                self.begun[data[:SHARED]] = last[:], count[:]
        if len(data) == len(piece):
            ends = count
        else:
            ends = [0] + [count[i] for i in range(1, len(data) + 1) if i == len(data) or data[i] & 0xC0 != 0x80]
        return bytes((b - a) & 255 for a, b in zip(ends, ends[1:]))

    def of_piece(self, piece: str) -> bytes:
        known = self.known.get(piece)
        if known is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            known = self.known[piece] = self.changes(piece)
        return known

    def total(self, text: str) -> int:
        """Count of a text without special strings."""
        return sum(_sum(self.of_piece(p)) for p in self.pieces.findall(text))

    def plain(self, text: str) -> bytearray:
        """Changes at every character of a text without special strings."""
        pieces = self.pieces.findall(text)
        known = self.known
        out = bytearray(b"".join([known.get(p) or self.of_piece(p) for p in pieces]))
        at = 0
        for i, piece in enumerate(pieces):
            n = len(piece)
            if piece[0] == "'" and n > 1 and piece[1].isalpha():
                # A cut contraction is a sign and a letter.
                counts = [self.total(piece[:k]) for k in range(n)] + [self.total(piece)]
                out[at : at + n] = bytes((b - a) & 255 for a, b in zip(counts, counts[1:]))
            elif n >= 1 and i + 1 < len(pieces) and piece.isspace() and pieces[i + 1][0].isspace():
                # Cut after the run's last character, the whole run is one piece.
                more = self.total(piece + pieces[i + 1][0]) - self.total(piece) - self.total(pieces[i + 1][0])
                for place, step in ((at + n, more), (at + n + 1, -more)):
                    out[place] = (out[place] + step) & 255
            at += n
        return out

    def prefix_changes(self, text: str) -> bytes:
        """Change of the token count at every character, as signed bytes."""
        if self.split is None or not self.split.search(text):
            return bytes(self.plain(text))
        out, at = bytearray(), 0
        for m in self.split.finditer(text):
            before = text[at : m.start()]
            part = self.plain(before)
            # Inside the special string a prefix is plain text that goes on from the last pieces.
            tail = "".join(self.pieces.findall(before)[-2:])
            counts = [self.total(tail + m[0][:k]) for k in range(len(m[0]))]
            counts.append(counts[0] + 1)
            out += part + bytes((b - a) & 255 for a, b in zip(counts, counts[1:]))
            at = m.end()
        return bytes(out + self.plain(text[at:]))


def _sum(changes: bytes) -> int:
    return sum(changes) - 256 * len(changes.translate(None, NOT_NEGATIVE))


def prefix_counts(changes: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, ... characters."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(changes, np.int8), dtype=np.int64)])


def tokens_of_prefix(changes: bytes, characters: int) -> int:
    return int(np.frombuffer(changes, np.int8)[:characters].sum(dtype=np.int64))


def longest_within(changes: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(prefix_counts(changes) <= budget)[-1])


_loaded: dict[int, Vocabulary] = {}


def vocabulary(definition: str) -> Vocabulary:
    """The vocabulary of a definition, parsed once in a worker."""
    key = hash(definition)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(definition)
    return _loaded[key]


def token_counts(
    docs: DataFrame, file: str, id: str = "doc_id", text: str = "text", limit: int = LIMIT, keep_prefixes: bool = False
) -> DataFrame:
    """Per document: ``id``, ``n_bytes``, ``n_tokens``, ``over_limit``; with ``keep_prefixes`` also ``changes``.

    ``file`` names a byte-level vocabulary in the layout of the tokenizers library;
    its text is sent to the tasks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Path(file).read_text(encoding="utf-8"))
    kind = docs.schema[id].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_tokens long, over_limit boolean" + (", changes binary" if keep_prefixes else "")

    def run(batches):
        words = vocabulary(sent.value)
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                changes = [words.prefix_changes(t) for t in texts]
                size = [int(np.frombuffer(c, np.int8).sum(dtype=np.int64)) for c in changes]
                columns = [
                    part.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array([n > limit for n in size], pa.bool_()),
                ]
                names = ["id", "n_bytes", "n_tokens", "over_limit"]
                if keep_prefixes:
                    columns.append(pa.array(changes, pa.binary()))
                    names.append("changes")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id).alias("id"), text).mapInArrow(run, schema).withColumnRenamed("id", id)
