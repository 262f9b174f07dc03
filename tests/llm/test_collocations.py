"""Phrase collocations against SQL over whole tables, and odd input."""

import duckdb
import pandas as pd
import pytest

from tallyflow.llm import collocations
from tallyflow.llm.queries import SQL
from tallyflow.plans.check import compare
from tests.llm.brute import odd_frame


def twin(rows: pd.DataFrame, top: int, least: int):
    connection = duckdb.connect()
    connection.register("documents", rows)
    return connection, SQL["op11_collocations"].replace("<= 2000", f"<= {top}").replace(">= 30", f">= {least}")


def rows(pairs):
    return pd.DataFrame(pairs, columns=["lang", "text"]).astype("string")


def spoken(n: int):
    """Phrases of many strengths: fixed runs, runs with a changing word, and words by chance."""
    out = []
    for i in range(n):
        words = [f"w{(i * k * k + 7 * k) % (11 + k % 5)}" for k in range(40)]
        words[5:9] = ["alpha", "beta", "gamma", "delta"]
        words[12:15] = ["alpha", "beta", f"x{i % 3}"]
        words[20:23] = ["Über", "straße", "漢字" if i % 7 else "漢"]
        words[i % 40] += ".!"[i % 2]
        out.append((["en", "de", None, "und"][i % 4], " ".join(words) + "\n tail\tof the, tail of the"))
    return out


@pytest.mark.parametrize("top,least", [(2000, 3), (5, 3), (12, 8)])
def test_equals_sql(spark, top, least):
    table = rows(spoken(120))
    connection, sql = twin(table, top, least)
    df = spark.createDataFrame(table.astype(object).where(table.notna(), None), "lang string, text string")
    ok, note = compare(collocations.collocations(df, top=top, least=least), connection, sql)
    assert ok, note


def test_ties_at_the_last_place_and_repeated_rows(spark):
    table = rows([("en", f"a{i} b{i}. c{i} d{i} e{i}") for i in range(20)] * 4)
    connection, sql = twin(table, 7, 4)
    df = spark.createDataFrame(table.astype(object), "lang string, text string")
    got = collocations.collocations(df, top=7, least=4)
    ok, note = compare(got, connection, sql)
    assert ok, note
    assert [r["rank"] for r in got.orderBy("rank").collect()] == list(range(1, 8))


def test_longer_phrases_with_four_fifths_drop_their_parts(spark):
    table = [("en", "one two three")] * 8 + [("en", "one two")] * 2 + [("en", "four five six")] * 7 + [("en", "four five")] * 3
    df = spark.createDataFrame(table, "lang string, text string")
    phrases = {r["phrase"] for r in collocations.collocations(df, least=7).collect()}
    assert phrases == {"one two three", "four five six", "four five"}  # 8 of 10 drop a part, 7 of 10 do not


def test_a_piece_ends_a_phrase(spark):
    df = spark.createDataFrame([("en", t) for t in ("a.b", "a\nb", "a, b", "a", "b", "a\x1cb", "a b")] * 40, "lang string, text string")
    assert collocations.collocations(df).count() == 0


def test_odd_rows_clashing_columns_and_empty_tables(spark):
    odd = odd_frame(spark).selectExpr("*", "1 AS a", "2 AS n", "3 AS h1", "'x' AS word")
    table = odd.select("lang", "text").toPandas().astype("string")
    connection, sql = twin(table, 50, 2)
    ok, note = compare(collocations.collocations(odd, top=50, least=2), connection, sql)
    assert ok, note
    assert collocations.collocations(odd.limit(0)).count() == 0
    nothing = spark.createDataFrame([(None, None), ("en", ""), ("en", " \t.\n")], "lang string, text string")
    assert collocations.collocations(nothing).count() == 0


def test_colliding_hashes_are_drawn_anew(spark, monkeypatch):
    seeds = []
    real = collocations._word_counts

    def poor(texts, seed):
        seeds.append(seed)
        rows = real(texts, seed)
        return rows.selectExpr("h % 2 AS h", "lang", "word", "n") if seed == 0 else rows

    monkeypatch.setattr(collocations, "_word_counts", poor)
    df = spark.createDataFrame([("en", "one two three")] * 9, "lang string, text string")
    assert [r["phrase"] for r in collocations.collocations(df, least=9).collect()] == ["one two three"]
    assert seeds == [0, 1]


def test_a_small_tally_adds_up_the_same(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 50)
    monkeypatch.setattr(collocations, "WORDS_HELD", 10)
    table = rows(spoken(40))
    connection, sql = twin(table, 20, 3)
    df = spark.createDataFrame(table.astype(object).where(table.notna(), None), "lang string, text string")
    ok, note = compare(collocations.collocations(df, top=20, least=3), connection, sql)
    assert ok, note
