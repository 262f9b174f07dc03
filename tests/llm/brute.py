"""Plain Python forms of what the operators compute, and odd documents."""

import re

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(WORD, lowered(text))


def shingles(text, k=5):
    w = words(text)
    return [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def labelled(text):
    seen, out = {}, []
    for s in shingles(text):
        seen[s] = seen.get(s, 0) + 1
        out.append((s, seen[s]))
    return out


def longest_common(a, b):
    """Length of the longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def odd_rows():
    """NULLs, empty and long texts, repeated rows, equal texts, a missing source."""
    prose = " ".join(f"w{i * i % 97}x{i % 13}" for i in range(300))
    return [
        (1, None, "en", "a", 0, 7),
        (2, "", "en", "a", 0, 7),
        (3, "", "en", "b", 0, 7),
        (4, prose, "en", "b", 5, 7),
        (5, prose, "de", None, 5, 7),
        (6, prose.replace("w4x2", "zz"), "de", None, 5, 7),
        (6, prose.replace("w4x2", "zz"), "de", None, 5, 7),
        (7, "one two", None, "c", None, None),
        (8, "  \n\t ", None, "c", None, None),
        (None, "no id at all", None, "c", None, None),
        (9, "é漢🙂 " * 4000, "xx", "a", None, 1),
        (10, "solo" * 30000, "xx", "a", None, 1),
    ]


def odd_frame(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)
