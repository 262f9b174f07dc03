"""Quotation linking: quoted passages are found again in the messages they come from.

A line's quote level is the number of ``>`` it begins with, spaces between them
allowed. Lines of one level that follow each other are a passage, whose words (letters and digits, lower case)
run on over line ends, so a quotation may be wrapped anew or take part of a line. A quoted passage is
cut into windows of ``WINDOW`` words (one of all its words if it has fewer), which are hashed and joined to
those of its conversation's earlier messages: a passage at level n to their level n - 1, for the level-1
quotation repeats what its origin wrote itself, deeper ones repeat what the origin quoted. A passage of one or two words
has to be a whole line there. Of messages that hold a window the latest counts, and a passage is found in a message that counts for at least
half of its windows. The message in which most level-1 passages (then most passages, then most
windows, then the later) are found is what a message replies to.

Every message gets the path of its replies: its own turn after the path of the message
it replies to; a message that quotes nothing, or nothing that is found, begins a path.
Sorting a conversation by ``reply_path`` puts replies after what they answer. Paths
are built by doubling, in about log2(longest chain) joins over the linked messages.

Only DataFrame functions; joins are on conversation and window hash, so a conversation
with a third of all messages is spread by its words. Conversations without quotations are not cut into windows.

Defined results: a NULL text counts as empty; passages without letters or
digits link nothing; rows with a NULL conversation or turn are kept, unlinked; of messages with the same
conversation and turn each links and is linked to as one; repeated rows are kept; other columns are
not read; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.session import materialize

MARKS = r"^\s*(?:>\s?)+"
WINDOW = 5
BREAK = "\x01"  # stands where lines of another level lie between
#: "Somebody wrote:" before a quotation goes with it.
ATTRIBUTION = r"(?i)^\s*(?:on\b.*\bwrote|.{0,80}\bwrote|am\b.*\bschrieb|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), r"\s", ""))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1)


def unquoted(text: Column) -> Column:
    """The message's own lines, without quotations and the line that introduces one."""
    lines = _split(text)
    kept = F.filter(
        F.transform(
            lines,
            lambda x, i: F.when(
                (level(x) == 0)
                & ~(x.rlike(ATTRIBUTION) & (F.coalesce(level(F.get(lines, i + 1)), F.lit(0)) > 0)),
                x,
            ),
        ),
        lambda x: x.isNotNull(),
    )
    # A text without a quotation is left as it is.
    any_ = F.coalesce(text, F.lit("")).rlike(r"(?m)^\s*>")
    return F.when(any_, F.regexp_replace(F.array_join(kept, "\n"), r"^\s*\n|\s+$", "")).otherwise(F.coalesce(text, F.lit("")))


def passages(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``conv, turn, level, passage, words, short``: every passage of every message; ``short`` are its lines of one or two words."""
    rows = messages.select(
        F.col(f"`{conversation}`").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        _split(F.translate(F.col(f"`{text}`"), BREAK, " ")).alias("lines"),
    ).filter("conv is not null and turn is not null")
    rows = rows.withColumn("levels", F.transform("lines", level))
    rows = rows.select("conv", "turn", F.explode(F.array_distinct("levels")).alias("level"), "lines", "levels")
    mine = F.transform("lines", lambda x, i: F.when(F.get("levels", i) == F.col("level"), F.regexp_replace(x, MARKS, "")).otherwise(F.lit(BREAK)))
    rows = rows.select("conv", "turn", "level", F.posexplode(F.split(F.array_join(mine, "\n"), BREAK)).alias("passage", "said"))
    few = F.filter(F.transform(_split(F.col("said")), _words), lambda w: F.size(w).between(1, 2))
    return rows.select("conv", "turn", "level", "passage", _words(F.col("said")).alias("words"), few.alias("short")).filter(F.size("words") > 0)


def _windows(words: Column, k: Column) -> Column:
    """Hashes of all runs of ``k`` words, each once."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, k), " "))))


def quotation_links(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``conv, turn, parent_turn, n_linked`` for messages whose quotations are found earlier."""
    quoting = messages.filter(F.col(f"`{text}`").rlike(r"(?m)^\s*>")).select(F.col(f"`{conversation}`").alias("_conv")).distinct()
    here = messages.join(quoting, F.col(f"`{conversation}`") == F.col("_conv"), "left_semi")
    parts = passages(here, conversation, turn, text)
    k = F.least(F.size("words"), F.lit(WINDOW))
    quoted = parts.filter("level > 0").select(
        "conv", (F.col("level") - 1).alias("level"), F.col("turn").alias("reply"), "passage", k.alias("k"), _windows(F.col("words"), k).alias("windows")
    )
    quoted = quoted.select("*", F.size("windows").alias("n")).select(*[c for c in quoted.columns if c != "windows"], "n", F.explode("windows").alias("window"))
    sizes = quoted.select("conv", "level", "k").distinct()  # at most WINDOW for a level of a conversation
    asked = parts.join(sizes, ["conv", "level"])
    whole = F.flatten(F.transform(F.filter("short", lambda w: F.size(w) == F.col("k")), lambda w: _windows(w, F.col("k"))))
    inside = F.when(F.size("words") >= F.col("k"), _windows(F.col("words"), F.col("k"))).otherwise(F.array().cast("array<bigint>"))
    said = asked.select("conv", "level", "turn", "k", F.explode(F.when(F.col("k") <= 2, whole).otherwise(inside)).alias("window")).distinct()
    # Of messages of a conversation with an equal window only the latest before the reply counts, found without pairing them all.
    key = ["conv", "level", "k", "window"]
    both = said.select(*key, "turn", F.lit(None).cast("int").alias("passage"), F.lit(None).cast("int").alias("n")).union(
        quoted.select(*key, F.col("reply").alias("turn"), "passage", "n")
    )
    needed = both.join(quoted.select(*key).distinct(), key, "left_semi")
    asks = F.col("passage").isNotNull()
    latest = Window.partitionBy(*key).orderBy("turn", asks.desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = needed.withColumn("origin", F.last(F.when(~asks, F.col("turn")), ignorenulls=True).over(latest)).filter(asks & (F.col("origin") < F.col("turn")))
    held = found.groupBy("conv", "turn", "level", "passage", "n", "origin").agg(F.count(F.lit(1)).alias("windows")).filter("2 * windows >= n")
    votes = held.groupBy("conv", "turn", "origin").agg(
        F.count_if(F.col("level") == 0).alias("own"),
        F.count(F.lit(1)).alias("every"),
        F.sum("windows").alias("size"),
        F.collect_set(F.struct("level", "passage")).alias("of"),
    )
    return votes.groupBy("conv", "turn").agg(
        F.max(F.struct("own", "every", "size", "origin")).alias("best"), F.size(F.array_distinct(F.flatten(F.collect_list("of")))).cast("long").alias("n_linked")
    ).select("conv", "turn", F.col("best.origin").alias("parent_turn"), "n_linked")


def _paths(links: DataFrame) -> DataFrame:
    """``conv, turn, path`` of linked messages: the turns from the first ancestor to the message."""
    rows = materialize(
        links.select("conv", "turn", F.col("parent_turn").alias("up"), F.array("turn").alias("path")), "paths"
    )
    while True:
        above = rows.select("conv", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("path").alias("before"))
        rows = materialize(
            rows.join(above, ["conv", "up"], "left").select(
                "conv",
                "turn",
                F.when(F.col("before").isNull(), F.col("up")).otherwise(F.col("further")).alias("up"),
                F.when(F.col("before").isNull(), F.col("path")).otherwise(F.concat("before", "path")).alias("path"),
                F.col("before").isNotNull().alias("moved"),
            ),
            "paths",
        )
        if rows.filter("moved").isEmpty():
            return rows.select("conv", "turn", F.concat(F.array("up"), "path").alias("path"))


def reply_ordered(
    messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Every message: ids, ``role``, ``message`` (without quotes), ``parent_turn``, ``depth``, ``reply_path``, ``n_quoted``, ``n_linked``."""
    links = materialize(quotation_links(messages, conversation, turn, text), "replies")
    paths = _paths(links) if not links.isEmpty() else links.select("conv", "turn", F.array("turn").alias("path"))
    linked = links.join(paths, ["conv", "turn"]).select(
        F.col("conv").alias("l_conv"), F.col("turn").alias("l_turn"), "parent_turn", "n_linked", "path"
    )
    rows = messages.select(
        F.col(f"`{conversation}`").alias("conv"), F.col(f"`{turn}`").alias("at"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text")
    )
    quoted = F.size(F.filter(_split(F.col("text")), lambda x: level(x) > 0))
    joined = rows.join(linked, (rows["conv"] == linked["l_conv"]) & (rows["at"] == linked["l_turn"]), "left")
    path = F.coalesce("path", F.array("at"))
    return joined.select(
        F.col("conv").alias(conversation),
        F.col("at").alias(turn),
        F.col("role").alias(role),
        unquoted(F.col("text")).alias("message"),
        "parent_turn",
        (F.size(path) - 1).cast("long").alias("depth"),
        F.array_join(F.transform(path, lambda t: F.lpad(t.cast("string"), 12, "0")), "/", "").alias("reply_path"),
        quoted.cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
    )
