"""Repair of conversation structure by a grammar-compressed dynamic programme.

A conversation is a row of turns. Each has a role and a first fault: blank (no visible character), duplicate
(role and text seen earlier), truncated (last visible character is none of ``.!?``), or none; that is one
symbol a turn. The cheapest edits (K keep 0, R give it to the user or assistant 2, D delete 3, which blank and duplicate turns
require, I insert an empty turn 2, and 1 for a truncated turn that stays) lead to the roles ``(s?(ua)+)?``; of equally
cheap ones the first in ASCII order is taken.

* The turns are range-partitioned by conversation and turn and cut into blocks, so a conversation of any length is spread.
* Re-Pair over the different symbol sequences of all blocks: every round counts neighbouring symbols in Spark and
  makes rules of the most frequent pairs that do not touch each other.
* Each rule has one min-plus matrix over the four states (start, after s, after u, after a), the product of
  its two parts' matrices, with the edits as a rope that shares the parts' ropes; counts of faults and of illegal neighbours are added up the
  same way. The rules are evaluated bottom-up once and sent to the tasks (at most ``RULES`` of them; what they leave
  of a sequence is multiplied symbol by symbol, so the bound changes no result).
* Blocks of a conversation are joined by the same product. The edits of each block then rewrite its texts, and the
  pieces are hashed in order.

Equally cheap edits from one state to one state are never prefixes of each other (the longer one would only add paid
insertions), so the least string of a product is the product of least strings.

Defined results: NULL conversation ids form one conversation; a NULL role or text is one space, a NULL turn comes first and is a
space in the key of the damage; turns of the same number are ordered by role and the md5 of the text, equal rows are adjacent; a role stands for its first
character (none for an empty role), so ``tool`` can only be re-roled or deleted. A conversation without turns has zeros, no edits and the hash of
the empty string. Other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import sys
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyflow.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROLES = "sua"  # initials with a place of their own; all others are one more
FAULTS = ["none", "truncated", "blank", "duplicate"]
SYMBOLS = 4 * len(FAULTS)  # symbol = 4 * fault + role
START, SYSTEM, USER, ASSISTANT = range(4)
BLOCK_TURNS, BLOCK_CHARACTERS = 4096, 1 << 20
RULES, AT_ONCE, ROUNDS = 512, 64, 24
SPACE = " \t\n\x0b\x0c\r"
NOTHING = sha256(b"").hexdigest()
NAMES = {USER: "user", ASSISTANT: "assistant"}


# ---- ropes and matrices ----


class Rope:
    """A string made of shared parts; it is written out only when it is read."""

    __slots__ = ("parts", "said")

    def __init__(self, said: str | None, parts: tuple[Rope, Rope] | None = None):
        self.said, self.parts = said, parts

    def __add__(self, other: Rope) -> Rope:
        return self if other is EMPTY else other if self is EMPTY else Rope(None, (self, other))

    def __str__(self) -> str:
        if self.said is None:
            out, todo = [], [self]
            while todo:
                rope = todo.pop()
                if rope.said is not None:
                    out.append(rope.said)
                else:
                    todo += rope.parts[::-1]
            self.said = "".join(out)
        return self.said


EMPTY = Rope("")
Cell = tuple[int, Rope]
Matrix = list[list[Cell | None]]


def least(a: Cell | None, b: Cell | None) -> Cell | None:
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if a[1] is b[1] or str(a[1]) <= str(b[1]) else b


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for row in a:
        line: list[Cell | None] = [None] * 4
        for k, x in enumerate(row):
            if x is not None:
                for j, y in enumerate(b[k]):
                    if y is not None:
                        cost, held = x[0] + y[0], line[j]
                        if held is None or cost <= held[0]:
                            line[j] = least(held, (cost, x[1] + y[1]))
        out.append(line)
    return out


def insertions() -> Matrix:
    """Turns inserted between two others: none, one or two."""
    one, two = (2, Rope("I")), (4, Rope("II"))
    free = (0, EMPTY)
    return [[free, None, one, two], [None, free, one, two], [None, None, free, one], [None, None, one, free]]


def edits(symbol: int) -> Matrix:
    """Insertions before a turn, and what is done to the turn."""
    fault, role = divmod(symbol, 4)
    matrix: Matrix = [[None] * 4 for _ in range(4)]
    for state in range(4):
        matrix[state][state] = (3, Rope("D"))
        if FAULTS[fault] in ("blank", "duplicate"):
            continue
        more = FAULTS[fault] == "truncated"
        next_ = ASSISTANT if state == USER else USER
        matrix[state][next_] = least(matrix[state][next_], (2 + more, Rope("R")))
        if role + 1 == next_:
            matrix[state][next_] = (0 + more, Rope("K"))
        elif role + 1 == SYSTEM and state == START:
            matrix[state][SYSTEM] = (0 + more, Rope("K"))
    return product(insertions(), matrix)


class Summary:
    """What the report needs of a run of turns; sums by ``+``."""

    __slots__ = ("matrix", "faults", "illegal", "first", "last")

    def __init__(self, matrix, faults, illegal, first, last):
        self.matrix, self.faults, self.illegal, self.first, self.last = matrix, faults, illegal, first, last

    @classmethod
    def of(cls, symbol: int) -> Summary:
        fault, role = divmod(symbol, 4)
        return cls(edits(symbol), [int(fault == f) for f in (2, 3, 1)], 0, role, role)

    def __add__(self, other: Summary) -> Summary:
        faults = [a + b for a, b in zip(self.faults, other.faults)]
        crossed = illegal(self.last, other.first)
        return Summary(product(self.matrix, other.matrix), faults, self.illegal + other.illegal + crossed, self.first, other.last)


def illegal(before: int, after: int) -> int:
    """0 for s-u, u-a and a-u; roles are numbered s, u, a, others."""
    return int((before, after) not in ((0, 1), (1, 2), (2, 1)))


# ---- grammar ----


def replaced(symbols: np.ndarray, rules: dict[tuple[int, int], int]) -> np.ndarray:
    """Every pair that is a rule's, from the left, replaced by the rule. The rules' pairs do not touch each other."""
    if len(symbols) < 2 or not rules:
        return symbols
    key = symbols[:-1].astype(np.int64) * (1 << 20) + symbols[1:]
    known = np.array(sorted((a * (1 << 20) + b, name) for (a, b), name in rules.items()), np.int64)
    at = np.searchsorted(known[:, 0], key)
    hit = known[np.minimum(at, len(known) - 1), 0] == key
    # in a run of one symbol every second pair counts
    run = np.flatnonzero(hit)
    start = np.ones(len(run), bool)
    start[1:] = np.diff(run) > 1
    first = run[np.flatnonzero(start)][np.cumsum(start) - 1] if len(run) else run
    run = run[(run - first) % 2 == 0]
    out = symbols.astype(np.int32)
    out[run] = known[at[run], 1]
    return np.delete(out, run + 1)


def grammar(sequences: DataFrame, most: int = RULES) -> list[tuple[int, int]]:
    """Rules by Re-Pair over the column ``symbols`` of different sequences; rule i has the symbol SYMBOLS + i.

    A round adds up neighbours in Spark, takes the most frequent pairs of which none ends with a symbol that
    another begins with, and replaces all of them at once. It ends when no pair occurs twice.
    """
    rules: list[tuple[int, int]] = []
    spark = sequences.sparkSession
    for _ in range(ROUNDS):
        if len(rules) >= most:
            break
        sent = spark.sparkContext.broadcast(list(rules))

        def neighbours(batches, sent=sent):
            rounds = by_round(sent.value)
            total: dict[int, int] = {}
            for batch in batches:
                for held in batch.column(0).to_pylist():
                    symbols = compressed(held, rounds)
                    if len(symbols) > 1:
                        key, n = np.unique(symbols[:-1].astype(np.int64) * (1 << 20) + symbols[1:], return_counts=True)
                        for k, c in zip(key.tolist(), n.tolist()):
                            total[k] = total.get(k, 0) + c
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([total[k] for k in keys], pa.int64())], ["pair", "n"])

        counted = sequences.select("symbols").mapInArrow(neighbours, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        best = counted.filter("n > 1").orderBy(F.desc("n"), "pair").limit(8 * AT_ONCE).collect()
        firsts, lasts, added = set(), set(), 0
        for r in best:
            a, b = divmod(r["pair"], 1 << 20)
            touching = a in lasts or b in firsts or (a == b and (a in firsts or b in lasts))
            if not touching and added < AT_ONCE and len(rules) < most:
                rules.append((a, b))
                firsts.add(a), lasts.add(b)
                added += 1
        if not added:
            break
        rules.append((-1, -1))  # end of a round
    return rules


def by_round(rules: list[tuple[int, int]]) -> list[dict[tuple[int, int], int]]:
    rounds: list[dict[tuple[int, int], int]] = [{}]
    for i, pair in enumerate(rules):
        if pair == (-1, -1):
            rounds.append({})
        else:
            rounds[-1][pair] = SYMBOLS + i
    return rounds


def compressed(held: bytes, rounds: list[dict[tuple[int, int], int]]) -> np.ndarray:
    symbols = np.frombuffer(held, np.uint8).astype(np.int32)
    for rules in rounds:
        symbols = replaced(symbols, rules)
    return symbols


class Evaluator:
    """The rules' summaries, bottom-up, and those of whole sequences."""

    def __init__(self, rules: list[tuple[int, int]]):
        self.known: dict[int, Summary] = {s: Summary.of(s) for s in range(SYMBOLS)}
        for i, (a, b) in enumerate(rules):
            if a >= 0:
                self.known[SYMBOLS + i] = self.known[a] + self.known[b]
        self.rounds = by_round(rules)
        self.seen: dict[bytes, Summary] = {}

    def summary(self, held: bytes) -> Summary:
        """Of a sequence that is not empty; the products go up a balanced tree."""
        found = self.seen.get(held)
        if found is None:
            parts = [self.known[s] for s in compressed(held, self.rounds).tolist()]
            while len(parts) > 1:
                parts = [a + b for a, b in zip(parts[::2], parts[1::2])] + (parts[-1:] if len(parts) % 2 else [])
            if len(self.seen) >= 20_000:
                self.seen.clear()
            found = self.seen[held] = parts[0]
        return found


# ---- turns ----


def damage(conversations: DataFrame) -> DataFrame:
    """Rows after damage by the hash of their key: conv_id, turn, role, text, and how often each."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), code.alias("_code"))
    text = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_code") == 4, "user").otherwise(F.col("role"))
    rows = rows.filter("_code <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_code") == 3, 2).otherwise(1).alias("copies"))
    return rows


def _symbol(first: Column) -> Column:
    visible = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    fault = F.when(visible == "", 2).when(~first, 3).when(~visible.isin(".", "!", "?"), 1).otherwise(0)
    initial = F.instr(F.lit(ROLES), F.substring("role", 1, 1))
    role = F.when((F.length("role") > 0) & (initial > 0), initial - 1).otherwise(3)
    return (4 * fault + role).cast("int")


def _blocks(turns: DataFrame) -> DataFrame:
    """Turns in order with ``block`` and place; a block is a run of turns of one conversation, bounded in turns and characters."""

    names = turns.columns

    def run(batches):
        task, block, place, size, last = None, 0, 0, 0, object()
        for batch in batches:
            ids, parts, lengths = batch.column("conv_id").to_pylist(), batch.column("part").to_pylist(), batch.column("size").to_pylist()
            blocks, places = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            for i, (conversation, part, length) in enumerate(zip(ids, parts, lengths)):
                task = part if task is None else task
                if conversation != last or place >= BLOCK_TURNS or size >= BLOCK_CHARACTERS:
                    block, place, size, last = block + 1, 0, 0, conversation
                blocks[i], places[i] = (task << 40) + block, place
                place, size = place + 1, size + length
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(blocks), pa.array(places)], [*names, "block", "place"])

    keys = ["conv_id", "turn", "role", "said", "copy"]
    ordered = turns.repartitionByRange(*keys).sortWithinPartitions(*keys)
    marked = ordered.withColumns({"part": F.spark_partition_id().cast("long"), "size": F.length("text")})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turns.schema.fields) + ", block long, place long"
    return marked.mapInArrow(run, schema)


# ---- repair ----


class Path:
    """Cheapest edits into each state, block after block.

    Of two paths only what follows their common beginning is kept to tell which one is less. Equal numbers of turns lie
    behind them, so if one begins with the other, the rest is insertions only.
    """

    def __init__(self):
        self.cost: list[int | None] = [0, None, None, None]
        self.steps: list[list[tuple[int, str] | None]] = []  # per step and state: state before, edits
        self.order: dict[tuple[int, int], int | tuple[str, str]] = {}

    def _compare(self, a: tuple[int, str], b: tuple[int, str]) -> int | tuple[str, str]:
        """-1 or 1, or what either has behind the other's end."""
        known = ("", "") if a[0] == b[0] else self.order[a[0], b[0]]
        if isinstance(known, int):
            return known
        x, y = known[0] + a[1], known[1] + b[1]
        if x.startswith(y) or y.startswith(x):
            return x[len(y) :], y[len(x) :]
        return -1 if x < y else 1

    def add(self, matrix: Matrix) -> None:
        cost: list[int | None] = [None] * 4
        step: list[tuple[int, str] | None] = [None] * 4
        for k, before in enumerate(self.cost):
            for j, cell in enumerate(matrix[k]) if before is not None else ():
                if cell is None or cost[j] is not None and before + cell[0] > cost[j]:
                    continue
                way = (k, str(cell[1]))
                if cost[j] is None or before + cell[0] < cost[j] or self._compare(way, step[j]) in (-1,):
                    cost[j], step[j] = before + cell[0], way
        order = {(i, j): self._compare(step[i], step[j]) for i in range(4) for j in range(4) if i != j and step[i] and step[j]}
        self.cost, self.order = cost, order
        self.steps.append(step)

    def best(self) -> tuple[int, list[tuple[int, str]]]:
        """Cost and steps of the cheapest edits that end well."""
        ends = [j for j in (START, ASSISTANT) if self.cost[j] is not None]
        end = ends[0]
        if len(ends) > 1 and (self.cost[ends[1]], 0) <= (self.cost[end], self._end_order(ends)):
            end = ends[1]
        cost, path = self.cost[end], []
        for step in reversed(self.steps):
            path.append(step[end])
            end = step[end][0]
        return cost, path[::-1]

    def _end_order(self, ends: list[int]) -> int:
        known = self.order[ends[0], ends[1]]
        return known if isinstance(known, int) else (known[0] > known[1]) - (known[0] < known[1])


def _pieces(blocks: DataFrame, rules: list[tuple[int, int]]) -> DataFrame:
    """Per block the edits and the state before them, and in a conversation's last block its report.

    The blocks of a conversation, one byte a turn, come to one task in order.
    """
    kind = blocks.schema["conv_id"].dataType
    sent = blocks.sparkSession.sparkContext.broadcast(rules)
    fields = [("conv_id", to_arrow_type(kind)), ("block", pa.int64()), ("state", pa.int32()), ("piece", pa.string())]
    fields += [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())]
    schema = pa.schema(fields)

    def finish(conversation, held):
        path, faults, wrong, before = Path(), [0, 0, 0], 0, None
        for _, s in held:
            path.add(s.matrix)
            faults = [a + b for a, b in zip(faults, s.faults)]
            wrong += s.illegal + (illegal(before, s.first) if before is not None else 0)
            before = s.last
        path.add(insertions())
        cost, steps = path.best()
        for i, (block, _) in enumerate(held[:-1]):
            yield (conversation, block, *steps[i], *[None] * 6)
        state, piece = steps[-2]
        yield (conversation, held[-1][0], state, piece + steps[-1][1], *faults, wrong, cost, "".join(p for _, p in steps))

    def record(rows):
        columns = list(zip(*rows)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches):
        evaluator = Evaluator(sent.value)
        last, held, out = None, [], []
        for batch in batches:
            for conversation, block, symbols in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "symbols"))):
                if held and conversation != last:
                    out += finish(last, held)
                    held = []
                held.append((block, evaluator.summary(symbols)))
                last = conversation
            if len(out) > 2000:
                yield record(out)
                out = []
        if held:
            out += finish(last, held)
        yield record(out)

    ordered = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    numbers = ", ".join(f"{c} long" for c in ("blank", "duplicate", "truncated", "illegal", "cost"))
    return ordered.mapInArrow(run, f"conv_id {kind.simpleString()}, block long, state int, piece string, {numbers}, audit string")


def _edited(batches):
    """(conversation, turn, role, text) after the edits, conversation by conversation; the turns come in order,
    the first of a block with its edits."""
    last, state, edit, at, turn = None, 0, "", 0, None

    def inserted(until: int):
        nonlocal state, at
        while at < until:
            state = ASSISTANT if state == USER else USER
            at += 1
            yield (last, turn, NAMES[state], "")

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "place", "role", "text", "state", "piece"))
        for conversation, number, place, role, text, before, piece in zip(*columns):
            if place == 0:
                yield from inserted(len(edit))
                last, state, edit, at = conversation, before, piece, 0
            turn = number
            here = at
            while edit[here] == "I":
                here += 1
            yield from inserted(here)
            at += 1
            if edit[here] == "K":
                state = ROLES.index(role[0]) + 1
                yield (conversation, turn, role, text)
            elif edit[here] == "R":
                state = ASSISTANT if state == USER else USER
                yield (conversation, turn, NAMES[state], text)
    yield from inserted(len(edit))


def _with_edits(turns: DataFrame, pieces: DataFrame) -> DataFrame:
    """Turns in order, all of a conversation in one task as a stream, the first of every block with the block's edits."""
    given = pieces.select("block", F.lit(0).cast("long").alias("place"), "state", "piece")
    rows = turns.select("conv_id", "turn", "block", "place", "role", "text").join(given, ["block", "place"], "left")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "place")


def _digests(turns: DataFrame, pieces: DataFrame) -> DataFrame:
    """Hash of every conversation's repaired turns."""
    kind = turns.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)

    def digest(batches):
        ids, out, last, held = [], [], None, None
        for conversation, _, role, text in _edited(batches):
            if held is None or conversation != last:
                if held is not None:
                    ids.append(last), out.append(held.hexdigest())
                last, held = conversation, sha256(f"{role}:{text}".encode())
            else:
                held.update(f"\n{role}:{text}".encode())
        if held is not None:
            ids.append(last), out.append(held.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array(out, pa.string())], ["conv_id", "repaired_sha256"])

    return _with_edits(turns, pieces).mapInArrow(digest, f"conv_id {kind.simpleString()}, repaired_sha256 string")


def _solved(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    turns = materialize(prepared(rows), "turns-marked")
    listed = F.array_sort(F.collect_list(F.struct("place", "symbol")))
    symbols = F.unhex(F.array_join(F.transform(listed, lambda s: F.lpad(F.hex(s["symbol"]), 2, "0")), ""))
    blocks = materialize(turns.groupBy("conv_id", "block").agg(symbols.alias("symbols")), "turn-blocks")
    rules = grammar(blocks.select("symbols").distinct())
    return turns, materialize(_pieces(blocks, rules), "turn-edits")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired turns themselves: conv_id, position from 1, turn (of an inserted one, the turn before it), role, text."""
    turns, pieces = _solved(rows)
    kinds = [turns.schema[c].dataType for c in ("conv_id", "turn")]
    conv, number = map(to_arrow_type, kinds)

    def run(batches):
        out, last, position = [], None, 0
        for conversation, turn, role, text in _edited(batches):
            position = position + 1 if conversation == last and position else 1
            last = conversation
            out.append((conversation, position, turn, role, text))
            if len(out) >= 1000:
                yield record(out)
                out = []
        yield record(out)

    def record(rows):
        columns = list(zip(*rows)) or [()] * 5
        arrays = [pa.array(c, k) for c, k in zip(columns, (conv, pa.int64(), number, pa.string(), pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, ["conv_id", "position", "turn", "role", "text"])

    schema = f"conv_id {kinds[0].simpleString()}, position long, turn {kinds[1].simpleString()}, role string, text string"
    return _with_edits(turns, pieces).mapInArrow(run, schema)


def prepared(rows: DataFrame) -> DataFrame:
    """Turns in order, with ``block``, ``place`` and ``symbol``. Every turn of ``rows`` has ``copies`` that follow each other."""
    rows = rows.withColumn("said", F.md5("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "said", "text").agg(F.sum("copies").alias("copies"))
    single = F.sequence(F.lit(1).cast("long"), F.col("copies"))
    rows = materialize(rows, "turns").select("conv_id", "turn", "role", "said", "text", F.explode(single).alias("copy"))
    placed = materialize(_blocks(rows), "turns-placed")
    firsts = placed.groupBy("conv_id", "role", "said").agg(F.min(F.struct("block", "place")).alias("at"))
    firsts = firsts.select(F.col("at.block").alias("block"), F.col("at.place").alias("place"), F.lit(True).alias("is_first"))
    marked = placed.join(firsts, ["block", "place"], "left").withColumn("symbol", _symbol(F.coalesce("is_first", F.lit(False))))
    return marked.select("conv_id", "turn", "block", "place", "role", "text", "symbol")


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation that has rows: gaps, faults, cost, edits and the hash of the repaired turns.

    ``rows`` has conv_id, turn, role, text and how many ``copies`` of the row follow each other.
    """
    turns, pieces = _solved(rows)
    gaps = turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    )
    report = pieces.filter("audit IS NOT NULL").drop("block", "state", "piece")
    digests = _digests(turns, pieces)
    out = report
    for table in (gaps, digests):  # equal ids, NULL included
        other = table.withColumnRenamed("conv_id", "_id")
        out = out.join(other, out["conv_id"].eqNullSafe(other["_id"]), "left").drop("_id")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(NOTHING)))  # all turns may be deleted


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """The damage by key hash, and its repair, for every conversation."""
    fixed = repair(damage(conversations)).withColumnRenamed("conv_id", "_id")
    every = conversations.select("conv_id").distinct()
    out = every.join(fixed, every["conv_id"].eqNullSafe(fixed["_id"]), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id",
        *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"),
    )
