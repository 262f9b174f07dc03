"""Quotations linked to their origins, reply order, odd messages."""

import random
import textwrap

from pyspark.sql import functions as F

from tallyflow.llm import quotations as Q
from tests.conftest import SMALL

SCHEMA = "conv_id long, turn long, role string, text string, depth string"
ROWS = [
    (1, 0, "a", "Where shall we  meet?\nAt noon?", "x"),
    (1, 1, "b", "I bring bread.", "x"),
    (1, 2, "c", "On Monday a wrote:\n> where shall we meet?\nAt the gate.", "x"),
    (1, 3, "a", "> I bring bread.\n\nGood.", "x"),
    (1, 4, "b", "> > Where shall we meet?\n> At the gate.\nFine.", "x"),
    (1, 5, "d", "> nobody said this\nOdd.", "x"),
    (2, 0, "a", "> Where shall we meet?", "x"),
    (2, 1, "b", None, "x"),
    (None, 0, "a", "> At noon?", "x"),
    (3, None, "a", "", "x"),
    (1, 1, "b", "I bring bread.", "x"),
]


def test_links_paths_and_clean_messages(spark):
    out = Q.reply_ordered(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(out) == len(ROWS)
    one = {r["turn"]: r for r in out if r["conv_id"] == 1}
    assert {t: r["parent_turn"] for t, r in one.items()} == {0: None, 1: None, 2: 0, 3: 1, 4: 2, 5: None}
    assert one[2]["message"] == "At the gate." and one[4]["message"] == "Fine." and one[5]["message"] == "Odd."
    assert one[4]["depth"] == 2 and one[4]["n_quoted"] == 2 and one[4]["n_linked"] == 2
    order = sorted(one, key=lambda t: one[t]["reply_path"])
    assert order == [0, 2, 4, 1, 3, 5]
    two = {r["turn"]: r for r in out if r["conv_id"] == 2}
    assert two[0]["parent_turn"] is None and two[0]["message"] == "" and two[1]["message"] == ""


def test_long_chain_and_empty_table(spark):
    rows = [(9, 0, "a", "line 0", "")] + [(9, i, "a", f"> line {i - 1}\nline {i}", "") for i in range(1, 30)]
    frame = spark.createDataFrame(rows, SCHEMA)
    out = {r["turn"]: r for r in Q.reply_ordered(frame).collect()}
    assert out[29]["depth"] == 29 and out[29]["message"] == "line 29"
    assert Q.reply_ordered(frame.limit(0)).count() == 0


def links(spark, rows):
    frame = spark.createDataFrame([(1, i, "a", t, "") for i, t in enumerate(rows)], SCHEMA)
    return {r["turn"]: r["parent_turn"] for r in Q.reply_ordered(frame).collect()}


def test_wrapped_anew_parts_of_lines_and_short_quotations(spark):
    long = "The quick brown fox jumps over the lazy dog while the band plays on, and nobody in the house minds at all."
    rows = [
        long + "\n\nSecond paragraph says more than the first one did.",
        "Yes.\nSomething else entirely is written here today.",
        "> The quick brown fox jumps over\n> the lazy dog while the band\n> plays on, and nobody\nWhy?",
        "> band plays on, and nobody in the house\nPart of a line.",
        "> yes\nA whole line of one word.",
        "> today\nOne word inside a line is not a quotation.",
        "> > the LAZY dog while\n> > the band plays on\n> Why?\nNested and wrapped anew.",
        "> minds at all.\n>\n> Second paragraph says more\nOver paragraphs.",
        "> The quick brown fox sat down and then it wrote a letter home to its mother\nMostly another text.",
    ]
    assert links(spark, rows) == {0: None, 1: None, 2: 0, 3: 0, 4: 1, 5: None, 6: 2, 7: 0, 8: None}


def test_replies_made_from_the_tables_find_their_messages(spark):
    """Every message of a table is quoted, wrapped anew, by a later message of its conversation."""
    table = spark.read.parquet(f"{SMALL}/conversations.parquet").filter("length(text) > 60")
    rng, rows, want = random.Random(4), [], {}
    for r in table.orderBy("conv_id", "turn").collect():
        rows.append((r["conv_id"], r["turn"], r["role"], r["text"], ""))
        words = r["text"].split()
        begin = rng.randrange(max(1, len(words) // 2))
        part = " ".join(words[begin : begin + 30])
        marks = rng.choice(["> ", ">", " >  "])
        rows.append((r["conv_id"], 1000 + r["turn"], "user", "\n".join(marks + x for x in textwrap.wrap(part, rng.randrange(20, 60))) + "\nI agree.", ""))
        if len(words[begin : begin + 30]) >= 8:
            want[r["conv_id"], 1000 + r["turn"]] = r["turn"]
    got = {(r["conv_id"], r["turn"]): r["parent_turn"] for r in Q.reply_ordered(spark.createDataFrame(rows, SCHEMA)).filter("turn >= 1000").collect()}
    assert len(want) > 20 and {k: got[k] for k in want} == want


def test_conversations_without_quotations_are_not_cut(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    assert Q.quotation_links(table.filter(~F.col("text").contains(">"))).count() == 0
