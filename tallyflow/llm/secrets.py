r"""Secrets in texts: checked patterns, and literals assigned to sensitive names.

Base spans come from three patterns (``assign``, ``access``, ``hex``), leftmost and non-overlapping
per kind; a match that fails its length is dropped and not tried again.

The method adds ``literal`` spans. A lexer reads source and configuration syntax into pairs of a name
and the literals that flow into it:

* ``name = v``, ``name := v``, ``name: v``, ``"name": v``, ``name => v``, ``x["name"] = v``, ``name: type = v``,
  ``--name v``, ``("name", "v")``, ``#define NAME v``, ``<name>v</name>``, ``key="name" value="v"``;
* a value is a quoted literal, a bare one, a reference (``other``, ``$OTHER``, ``${OTHER}``, ``%OTHER%``), a call with
  literals, or several of them joined by ``+``, ``.``, ``or``, ``||``, ``??`` or side by side.

Constants are propagated in text order: a name stands for the literals last given to it (if there are none before,
for the first given later, as configuration may refer ahead), so ``k = "..."; api_key = k`` marks
the literal of ``k``. A literal scores what the most sensitive name that it reaches scores, plus its own form (length,
mixed characters, spread; placeholders and plain words lose); ``SCORE`` or more is a secret. Spans hold the literal without its quotes. A
literal that overlaps a base span adds nothing.

Defined results: NULL and empty texts have no spans; repeated rows give the same rows; other columns are not
read; an empty table gives an empty one. Every pass is linear in the text.
"""

from __future__ import annotations

import math
import re
import sys
from bisect import bisect_left
from collections import Counter
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ["assign", "access", "hex", "literal"]
SCORE = 4.0

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # runs are whole, so a length is as good as a later test
HEX = re.compile(r"[0-9a-f]{16,}")

# What each part of a target name says, alone or together: the score of a name is the largest plus the sum of the negative ones.
NAME_PARTS = {
    "password": 4, "passwd": 4, "passwort": 4, "pwd": 4, "passphrase": 4, "pass": 2.5, "secret": 4, "token": 3,
    "credential": 3.5, "credentials": 3.5, "apikey": 4, "api key": 4, "access key": 3.5, "private key": 4, "secret key": 4,
    "signing key": 4, "encryption key": 4, "master key": 4, "auth key": 4, "account key": 3.5, "connection string": 2,
    "auth": 2, "authorization": 2.5, "bearer": 3, "jwt": 3, "pin": 2, "key": 1, "salt": 1.5, "cookie": 1, "session": 1,
}
SENSITIVE = re.compile("|".join({part.split()[-1] for part in NAME_PARTS}), re.I)  # no other text has a sensitive name
HARMLESS = set(
    "public count counts length len size max min limit num number type kind name file filename path dir url uri field label hint policy "
    "expiry expires ttl timeout example sample placeholder regex pattern format column index id ids reset forgot enabled required prompt".split()
)
PLACEHOLDER = re.compile(r"(?i)(change|replace|insert|your|example|sample|dummy|default|placeholder|redacted|todo|none|null|undefined|true|false|x{3,}|\*{3,}|\.{3,})")

_QUOTED = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`\n]*`"
PAIR = re.compile(
    r"<(?P<tag>[A-Za-z_][\w.\-]*)>(?=[^<>\s])"
    r"|\#[ \t]*define[ \t]+(?P<define>\w+)[ \t]+(?=\S)"
    r"|(?<![\w$.\-])(?P<flag>--)?(?P<name>[A-Za-z_$][\w$.\-]*+)"
    r"(?:(?:[\"'`]?\]?|\[\d*\])[ \t]*(?::=|=>|=(?![=~>])|:(?![:/=]))[ \t]*(?:\n[ \t]*(?=[\"']))?"
    r"|[\"'][ \t]*,[ \t]*(?=[\"'])"
    r"|(?(flag)[ \t]+(?=[^\s\-=:|&;])|(?!)))"
)
TERM = re.compile(
    r"(?:[rbfuRBFU]{1,2}(?=[\"']))?(?P<quoted>" + _QUOTED + r")"
    r"|\$\{(?P<shell>\w+)\}|\$(?P<var>[A-Za-z_]\w*)|%(?P<percent>[A-Za-z_]\w*)%"
    r"|(?P<call>[A-Za-z_][\w.]*+)\("
    r"|(?P<bare>[^\s\"'`,;(){}\[\]<>=&|:]++(?:={1,2}(?![^\s,;)}\]]))?)"
)
JOIN = re.compile(r"[ \t]*(?:\+|\.(?=[ \t\"'$])|\|\||\?\?|\bor\b)[ \t]*|(?<=[\"'`])[ \t]*(?=[\"'])")
TYPED = re.compile(r"[ \t]*=(?![=~>])[ \t]*")
ARGUMENT = re.compile(r"[ \t]*(?:(" + _QUOTED + r")|[^\s\"'`(),]+)[ \t]*(,|\))")
INSIDE = re.compile(r"\$\{(\w+)\}|\{(\w+)\}")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class Pair(NamedTuple):
    name: str
    at: int
    literals: list[tuple[int, int]]  # code points, end exclusive
    words: list[tuple[int, int]]  # bare values: names if such are known, else literals
    references: list[str]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base patterns, in order."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def plain_name(name: str) -> str:
    """What a name is known by: without its object and case."""
    return name.removeprefix("self.").removeprefix("this.").strip("$").lower()


def _value(text: str, at: int, stop: int) -> tuple[list, list, list, int, int]:
    """Literals, bare words and references of the expression that begins at a place; its end; the end of its last literal."""
    literals: list[tuple[int, int]] = []
    words: list[tuple[int, int]] = []
    references: list[str] = []
    read = at
    while term := TERM.match(text, at, stop):
        at = term.end()
        if term["quoted"]:
            begin, end = term.start("quoted") + 1, term.end("quoted") - 1
            literals.append((begin, end))
            references += [a or b for a, b in INSIDE.findall(text, begin, end)]
            read = at
        elif term["call"]:
            while argument := ARGUMENT.match(text, at, stop):
                at = argument.end()
                if argument[1]:
                    literals.append((argument.start(1) + 1, argument.end(1) - 1))
                if argument[2] == ")":
                    break
        elif term["bare"]:
            end = len(term["bare"].rstrip(".!?")) + term.start("bare")
            if end > term.start("bare"):
                words.append((term.start("bare"), end))
        else:
            references.append(term["shell"] or term["var"] or term["percent"])
        joined = JOIN.match(text, at, stop)
        if not joined:
            break
        at = joined.end()
    return literals, words, references, at, read


def pairs(text: str) -> list[Pair]:
    """Names and what they are given, in text order; pairs inside a quoted literal follow the pair that it belongs to."""
    out: list[Pair] = []
    todo = [(0, len(text))]
    while todo:
        at, stop = todo.pop()
        m = PAIR.search(text, at, stop)
        if not m:
            continue
        at = m.end()
        if m["tag"]:
            end = text.find("<", at, stop)
            if end > 0 and text.startswith(f"</{m['tag']}", end):
                out.append(Pair(m["tag"], m.start(), [(at, end)], [], []))
            todo.append((at, stop))
            continue
        literals, words, references, end, read = _value(text, at, stop)
        if m["name"] and not m["flag"] and text[m.end("name") : at].strip(" \t\"'`]") == ":" and (typed := TYPED.match(text, end, stop)):
            literals, words, references, end, read = _value(text, typed.end(), stop)  # name: type = value
        todo.append((max(at, read), stop))
        if read > at:  # what is quoted may hold pairs of its own, as connection strings do
            todo += [span for span in reversed(literals) if span[1] <= read]
        if literals or words or references:
            name, last = m["name"] or m["define"], out[-1] if out else None
            if last and name.lower() == "value" and last.name.lower() in ("key", "name") and last.literals and "\n" not in text[last.at : at]:
                name = text[slice(*last.literals[0])]
            out.append(Pair(name, m.start(), literals, words, references))
    return out


def name_score(name: str) -> float:
    words = [w.lower() for w in CAMEL.findall(name)]
    both = [f"{a} {b}" for a, b in zip(words, words[1:])]
    known = [NAME_PARTS[w] for w in [*words, *both] if w in NAME_PARTS]
    if not known:
        return 0.0
    return max(known) - 4.0 * any(w in HARMLESS for w in words)


def literal_score(literal: str) -> float:
    """Form of a literal: long, mixed and spread is likely a secret; a placeholder or plain word is not."""
    size = len(literal)
    if size < 6 or size > 4096 or any(c.isspace() for c in literal):
        return -10.0
    counts = Counter(literal)
    spread = -sum(n / size * math.log2(n / size) for n in counts.values())
    lower, upper, digit = any(map(str.islower, literal)), any(map(str.isupper, literal)), any(map(str.isdigit, literal))
    other = not literal.isalnum()
    score = (size >= 8) * 0.5 + (size >= 16) * 0.5 + (size >= 24) * 0.5 + (spread >= 2.5) * 0.5 + (spread >= 3.5) * 0.5
    score += digit * (lower or upper) * 1.0 + lower * upper * 0.5 + other * 0.25
    if not digit and not other:  # a plain word
        score -= 1.5
    if digit and not lower and not upper:
        score -= 1.0
    if PLACEHOLDER.search(literal) or len(counts) < 4 or literal[0] in "<{[" or "://" in literal and "@" not in literal:
        score -= 4.0
    return score


def assigned_literals(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, target name, score) of all literals that reach a sensitive name, with the most sensitive one."""
    if not SENSITIVE.search(text):
        return []
    found = pairs(text)
    names = [plain_name(p.name) for p in found]
    first: dict[str, int] = {}
    for i, name in enumerate(names):
        first.setdefault(name, i)
    # Every pair points at the pairs that gave its references their values.
    sources: list[list[int]] = []
    literals: list[list[tuple[int, int]]] = []
    current: dict[str, int] = {}
    for i, p in enumerate(found):
        used, own = set(), list(p.literals)
        for word in p.words:
            known = plain_name(text[slice(*word)])
            if known not in first:
                own.append(word)
            elif known in current or first[known] != i:
                used.add(current.get(known, first[known]))
        used |= {current.get(r, first[r]) for r in map(plain_name, p.references) if r in first}
        sources.append(sorted(used - {i}))
        literals.append(own)
        current[names[i]] = i
    # The best score first, so every pair is settled once, whatever circles there are.
    heap = [(-score, i, found[i].name) for i in range(len(found)) if (score := name_score(found[i].name)) > 0]
    heapify(heap)
    settled: set[int] = set()
    best: dict[tuple[int, int], tuple[float, str]] = {}
    while heap:
        score, i, name = heappop(heap)
        if i in settled:
            continue
        settled.add(i)
        for span in literals[i]:
            best.setdefault(span, (-score, name))
        for j in sources[i]:
            if j not in settled:
                heappush(heap, (score, j, name))
    return [(a, b, name, own + literal_score(text[a:b])) for (a, b), (own, name) in sorted(best.items())]


def literal_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, float]]:
    """(start, kind, end, name, score) of sensitive literals that no base span overlaps, without overlaps of their own."""
    ends, top = [], 0
    for _, _, end in base:  # furthest end so far
        top = max(top, end)
        ends.append(top)
    starts = [s for s, _, _ in base]
    out, last = [], 0
    for a, b, name, score in assigned_literals(text):
        i = bisect_left(starts, b)
        if score >= SCORE and a >= last and (i == 0 or ends[i - 1] <= a):
            out.append((a, 3, b, name, score))
            last = b
    return out


_SPANS = "array<struct<kind:string,start:int,end:int,name:string,score:double>>"


def find_secrets(docs: DataFrame, text: str = "text", output: str = "secrets") -> DataFrame:
    """``docs`` with all spans, by start and then kind; ``name`` and ``score`` only where a name led to it."""
    return docs.withColumn(output, _finder()(F.col(text).cast("string")))


def _finder():
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("score", pa.float64())]))

    @F.arrow_udf(_SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            base = base_spans(text) if text else []
            both = sorted([(*s, None, None) for s in base] + (literal_spans(text, base) if text else []), key=lambda s: s[:2])
            rows.append([{"kind": KINDS[k], "start": a, "end": b, "name": name, "score": score} for a, k, b, name, score in both])
        return pa.array(rows, kind)

    return spans.asNondeterministic()  # so that several uses do not lex again


def _joined(spans):
    said = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(said, ",")


def secret_scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: counts of the base kinds, the hash of the base spans, all spans, and the number of added ones."""
    rows = find_secrets(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")), "_text", "_all")
    of = lambda kind: F.size(F.filter("_all", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("_all", lambda s: s["kind"] != "literal")
    return rows.select(
        F.col("_id").alias(id),
        *[of(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("_all")).alias("spans"),
        of("literal").alias("n_literal"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret replaced by its kind in brackets; overlapping spans are replaced together."""

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            base = base_spans(t) if t else []
            spans = sorted([(a, k, b) for a, k, b in base] + ([s[:3] for s in literal_spans(t, base)] if t else []))
            parts, at = [], 0
            for a, k, b in spans:
                if a >= at:
                    parts += [t[at:a], f"[{KINDS[k]}]"]
                at = max(at, b)
            out.append(t if not spans else "".join(parts) + t[at:])
        return pa.array(out, pa.string())

    return docs.withColumn(text, cleaned(F.col(text)))
