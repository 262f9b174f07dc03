"""Conversation repair against a plain search over all edits."""

import random
from hashlib import sha256
from zlib import crc32

import pytest

from tallyflow.llm import repair

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = " " if role is None else role, " " if text is None else text
        code = crc32(key.encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        role = "user" if code == 4 else role
        out += [(conv, turn, role, text)] * (2 if code == 3 else 1)
    return out


def solve(turns):
    """turns: (role, text) in order. The whole table by state, as plain strings."""
    seen, faults, initials = set(), [], []
    for role, text in turns:
        seen_text = text.strip(SPACE)
        fault = "blank" if not seen_text else "duplicate" if (role, text) in seen else "truncated" if seen_text[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        initials.append(role[:1])
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    states = {"": (0, "", ())}

    def insert(states):
        out = dict(states)
        for _ in range(2):
            for state, (cost, audit, said) in list(out.items()):
                for nxt in follow[state].replace("s", ""):
                    new = (cost + 2, audit + "I", said + ((("user" if nxt == "u" else "assistant"), ""),))
                    if nxt not in out or new[:2] < out[nxt][:2]:
                        out[nxt] = new
        return out

    for (role, text), fault, initial in zip(turns, faults, initials):
        new = {}

        def offer(state, way):
            if state not in new or way[:2] < new[state][:2]:
                new[state] = way

        for state, (cost, audit, said) in insert(states).items():
            offer(state, (cost + 3, audit + "D", said))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if initial and initial in follow[state]:
                offer(initial, (cost + more, audit + "K", said + ((role, text),)))
            for nxt in follow[state].replace("s", ""):
                offer(nxt, (cost + 2 + more, audit + "R", said + (("user" if nxt == "u" else "assistant", text),)))
        states = new
    cost, audit, said = min((w for s, w in insert(states).items() if s in ("", "a")), key=lambda w: w[:2])
    wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return [*(faults.count(f) for f in ("blank", "duplicate", "truncated")), wrong, cost, audit], said


def brute(rows):
    after, out = {}, []
    for conv, turn, role, text in damaged(rows):
        after.setdefault(conv, []).append((turn is not None, turn or 0, role, sha_key(text), text))
    for conv in dict.fromkeys(r[0] for r in rows):
        turns = sorted(after.get(conv, []))
        numbers = {t[1] for t in turns if t[0]}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        report, said = solve([(t[2], t[4]) for t in turns])
        out.append((conv, gaps, *report, sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()))
    return sorted(out, key=repr)


def sha_key(text):
    from hashlib import md5

    return md5(text.encode()).hexdigest()


def result(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in repair.damage_and_repair(df).select(*COLUMNS).collect()), key=repr)


def chance_rows(seed, conversations=60, longest=14):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "cut off", "", " \t", "Ünï 漢.", "cut\n", "Yes."]
    roles = ["user", "assistant", "system", "tool", "", "user", "assistant"]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(longest)):
            if rng.random() < 0.9:
                role = rng.choice(roles) if rng.random() < 0.5 else ["user", "assistant"][turn % 2]
                rows.append((conv, turn, role, rng.choice(texts) if rng.random() < 0.4 else f"Turn {conv} {turn}" + rng.choice(".!?;")))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_search(spark, seed):
    rows = chance_rows(seed)
    assert result(spark, rows) == brute(rows)


def test_small_blocks_few_rules_and_hot_conversations(spark, monkeypatch):
    rows = chance_rows(3, 4, 90) + [(99, i, "user" if i % 3 else "assistant", "same." if i % 5 else f"t{i}") for i in range(400)] + [(98, 7, "user", "copy.")] * 120
    want = brute(rows)
    assert result(spark, rows) == want
    monkeypatch.setattr(repair, "BLOCK_TURNS", 7)
    monkeypatch.setattr(repair, "RULES", 3)
    assert result(spark, rows) == want


def test_odd_rows_clashing_columns_and_empty_tables(spark):
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (1, None, "user", "a."), (1, None, "user", "a."), (1, 5, "assistant", None), (2, 5, None, "x" * 200_000)]
    rows += [(3, t, r, x) for t in (1, 2, 2) for r in ("user", "assistant") for x in ("b.", "a.")]
    assert result(spark, rows) == brute(rows)
    clashing = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS block", "2 AS place", "'x' AS symbol", "3 AS copies", "4 AS audit")
    assert sorted((tuple(r) for r in repair.damage_and_repair(clashing).select(*COLUMNS).collect()), key=repr) == brute(rows)
    assert repair.damage_and_repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_conversation_without_turns_has_zeros(spark):
    conv = next(c for c in range(1000) if crc32(f"{c}:0".encode()) % 20 == 0)
    assert result(spark, [(conv, 0, "user", "gone.")]) == [(conv, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]


def test_repaired_turns_are_what_the_hash_says(spark):
    rows = chance_rows(5, 30)
    df = spark.createDataFrame(rows, SCHEMA)
    after = repair.damage(df)
    said = {}
    for r in repair.repaired_turns(after).orderBy("conv_id", "position").collect():
        said.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, *_, digest in brute(rows):
        assert sha256("\n".join(said.get(conv, [])).encode()).hexdigest() == digest


def test_rules_expand_to_their_sequences(spark):
    rng = random.Random(9)
    held = [bytes(rng.choice([1, 2, 2, 1, 9]) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    df = spark.createDataFrame([(bytearray(h),) for h in set(held)], "symbols binary")
    rules = repair.grammar(df)

    def expand(s):
        return expand(rules[s - repair.SYMBOLS][0]) + expand(rules[s - repair.SYMBOLS][1]) if s >= repair.SYMBOLS else [s]

    packed = [repair.compressed(h, repair.by_round(rules)).tolist() for h in held]
    assert [bytes(x for s in p for x in expand(s)) for p in packed] == held
    assert sum(map(len, packed)) < 0.6 * sum(map(len, held))
