"""Mixing sources to target weights: min-cost flow over membership patterns, then seeded documents.

A document may belong to several sources. Documents are aggregated by the set of
sources they belong to (their pattern); a network sends the patterns' words to the
sources' quotas. A pattern offers its words once at no cost, a second time at a
cost and so on up to ``copies`` times at growing (convex) cost. Only the arcs that
leave the start cost anything, so augmenting over the cheapest layer first, and over
the shortest path within it, is the successive-shortest-path method and gives a
flow of least cost among the largest.

A pattern that is to give k whole copies and r further words gives k copies of each
of its documents and one more of those with the least seeded hashes of id and text, until
exactly r words are reached. The edge is found in three steps, each on what the one before
left: the sums of ``SLOTS`` hash slots, the sums of the hashes within the slot at the edge, and
the rows of the hash at the edge, which are alike and counted by the partition they were stored in.
The last row at the edge gives a part of its words.

Only sums by pattern reach the driver; there may be at most ``MOST_PATTERNS``.

Defined results: a NULL text has no words and takes none; a NULL source is a source
of its own, the last; of rows with the same id (or none) and the same text, any may be the ones
that give more, but how many do is fixed; other columns are kept. Empty tables give empty results.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyflow.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
COPIES = 3
SLOTS = 65_536
SEED = 20
MOST_PATTERNS = 100_000

Flow = dict[tuple[int, int], float]


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(names: list[str | None]) -> list[float]:
    """1, 2, 3, repeating, by code points, NULL last."""
    order = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))
    weights = [0.0] * len(names)
    for rank, i in enumerate(order):
        weights[i] = float(rank % 3 + 1)
    return weights


def share_out(sizes: list[int], weights: list[float], copies: int = COPIES) -> list[float]:
    """Targets: all words by weight, none above ``copies`` times its source, the excess shared again."""
    targets, open_, rest = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        above = [i for i in open_ if rest * weights[i] / total > copies * sizes[i]]
        if not above:
            for i in open_:
                targets[i] = rest * weights[i] / total
            break
        for i in above:
            targets[i] = float(copies * sizes[i])
            rest -= targets[i]
        open_ = [i for i in open_ if i not in above]
    return targets


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[float], copies: int = COPIES) -> Flow:
    """Words that each pattern sends to each source, at the least repetition cost."""
    flow: Flow = {}
    into: list[list[int]] = [[] for _ in quotas]
    for p, (sources, _) in enumerate(patterns):
        for s in sources:
            flow[p, s] = 0.0
            into[s].append(p)
    left = [0.0] * len(patterns)
    need = [float(q) for q in quotas]
    least = 1e-9 * max(1.0, sum(need))
    for _ in range(copies):
        for p, (_, size) in enumerate(patterns):
            left[p] += size
        while True:
            # Shortest path from a pattern with words left to a source with an open quota.
            back: dict[tuple[str, int], tuple[str, int] | None] = {("p", p): None for p, x in enumerate(left) if x > least}
            queue, end = deque(back), None
            while queue and end is None:
                kind, i = queue.popleft()
                if kind == "p":
                    for s in patterns[i][0]:
                        if ("s", s) not in back:
                            back["s", s] = ("p", i)
                            if need[s] > least:
                                end = ("s", s)
                                break
                            queue.append(("s", s))
                else:
                    for p in into[i]:
                        if flow[p, i] > least and ("p", p) not in back:
                            back["p", p] = ("s", i)
                            queue.append(("p", p))
            if end is None:
                break
            path = [end]
            while back[path[-1]] is not None:
                path.append(back[path[-1]])
            path.reverse()  # pattern, source, pattern, source, ...
            steps = list(zip(path, path[1:]))
            most = min(left[path[0][1]], need[end[1]], *[flow[b[1], a[1]] for a, b in steps if a[0] == "s"])
            left[path[0][1]] -= most
            need[end[1]] -= most
            for a, b in steps:
                if a[0] == "p":
                    flow[a[1], b[1]] += most
                else:
                    flow[b[1], a[1]] -= most
    return flow


def _sized(docs: DataFrame, id: str, text: str, members: Column) -> DataFrame:
    key = F.xxhash64(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(SEED))
    made = docs.select("*", size_of(f"`{text}`").alias("__size"), key.alias("__key"), members.alias("__pattern"))
    # Stored with the row, so that the number stays what it is when a task is run again.
    return made.withColumn("__slot", F.pmod("__key", F.lit(SLOTS))).withColumn("__row", F.monotonically_increasing_id())


def _edge(sums: DataFrame, plan: DataFrame, place: list[str], rest: str, left: str) -> DataFrame:
    """By pattern: the first ``place``, in order, at which the words so far pass ``rest``, and the words ``left`` there."""
    so_far = Window.partitionBy("__pattern").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    rows = sums.join(F.broadcast(plan.select("__pattern", rest)), "__pattern")  # a row per pattern, which the driver made
    rows = rows.withColumn("before", F.coalesce(F.sum("words").over(so_far), F.lit(0)))
    rows = rows.filter((F.col("before") <= F.col(rest)) & (F.col("before") + F.col("words") > F.col(rest)))
    found = rows.select("__pattern", *[F.col(c).alias(f"{c}_at") for c in place], (F.col(rest) - F.col("before")).alias(left))
    return plan.join(found, "__pattern", "left")


def _plan(spark: SparkSession, sized: DataFrame, weights, copies: int) -> DataFrame:
    """By pattern: words of its sources and their targets, whole copies, the slot at the edge and its share."""
    sums = sized.groupBy("__pattern").agg(F.sum("__size").alias("size"))
    rows = sums.limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    names = list({s for r in rows for s in r["__pattern"]})
    number = {name: i for i, name in enumerate(names)}
    sizes = [0] * len(names)
    for r in rows:
        for s in r["__pattern"]:
            sizes[number[s]] += r["size"]
    patterns = [(tuple(number[s] for s in r["__pattern"]), r["size"]) for r in rows]
    total = sum(r["size"] for r in rows)
    targets = share_out(sizes, weights(names), copies)
    over = sum(targets) / total if total else 1.0  # words in several sources count once in what is shared out
    targets = [t / over for t in targets] if over > 1 else targets
    flow = route(patterns, targets, copies)
    sent = [0.0] * len(patterns)
    for (p, _), words in flow.items():
        sent[p] += words
    first = lambda p: patterns[p][0][0] if patterns[p][0] else None
    table = []
    for p, r in enumerate(rows):
        whole = min(int((sent[p] + 1e-6) // r["size"]), copies) if r["size"] else 0
        rest = max(0, round(sent[p] - whole * r["size"])) if whole < copies else 0
        at = first(p)
        table.append((r["__pattern"], sizes[at] if at is not None else 0, targets[at] if at is not None else 0.0, whole, rest))
    kind = sized.schema["__pattern"].dataType.simpleString()
    plan = spark.createDataFrame(table, f"__pattern {kind}, source_size long, target double, __whole int, __rest long")
    slots = sized.groupBy("__pattern", "__slot").agg(F.sum("__size").alias("words"))
    plan = materialize(_edge(slots, plan, ["__slot"], "__rest", "__slot_rest"), "mix_slots")
    edge = sized.join(F.broadcast(plan.select("__pattern", "__slot_at")), "__pattern").filter("__slot = __slot_at")
    hashes = edge.groupBy("__pattern", "__key", "__size").agg(F.sum("__size").alias("words"))
    return materialize(_edge(hashes, plan, ["__key", "__size"], "__slot_rest", "__key_rest"), "mix")


def _taken(stored: DataFrame, plan: DataFrame) -> DataFrame:
    """``stored`` with the columns of ``plan`` and ``__taken``."""
    rows = stored.join(F.broadcast(plan), "__pattern")
    place, at = F.struct("__slot", "__key", "__size"), F.struct("__slot_at", "__key_at", "__size_at")
    is_edge = F.col("__key_at").isNotNull() & (place == at)
    # No edge: there are no words.
    more = F.when(F.col("__key_at").isNotNull() & (place < at), F.col("__size")).otherwise(0)
    others = rows.filter(~is_edge).withColumn("__more", more.cast("long"))
    alike = rows.filter(is_edge).withColumn("__part", F.shiftright("__row", 33))
    before = Window.partitionBy("__pattern").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = alike.groupBy("__pattern", "__part").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select("__pattern", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__pattern", "__part").orderBy("__row")
    alike = alike.withColumn("__number", F.row_number().over(inside) - 1).join(parts, ["__pattern", "__part"])
    left = F.col("__key_rest") - (F.col("__before") + F.col("__number")) * F.col("__size")
    alike = alike.withColumn("__more", F.greatest(F.lit(0), F.least(left, F.col("__size"))).cast("long"))
    every = others.unionByName(alike.select(*others.columns))
    return every.withColumn("__taken", F.col("__size") * F.col("__whole") + F.col("__more"))


def mix_sources(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    members: Column | None = None,
    weights=cyclic_weights,
    copies: int = COPIES,
    keep: bool = False,
) -> DataFrame:
    """Per document: ``id``, ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted).

    ``members`` is an array column of the sources of a document, each once and
    sorted (default: its one ``source``); with several, ``source_size`` and ``target``
    are those of the first. ``weights`` gives a list of source names their weights.
    ``keep`` returns all columns of ``docs`` and the four; what clashes gets ``mix_``.
    """
    members = F.array(F.col(f"`{source}`")) if members is None else members
    sized = _sized(docs, id, text, members)
    kept = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)] if keep else [F.col(f"`{id}`").alias("__id")]
    stored = materialize(sized.select(*kept, "__size", "__slot", "__key", "__row", "__pattern"), "sized")
    plan = _plan(docs.sparkSession, stored, weights, copies)
    rows = _taken(stored, plan)
    made = {"size": F.col("__size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": F.col("__taken")}
    if not keep:
        return rows.select(F.col("__id").alias(id), *[c.alias(n) for n, c in made.items()])
    return rows.select(
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)],
        *[c.alias(f"mix_{n}" if n in docs.columns else n) for n, c in made.items()],
    )
