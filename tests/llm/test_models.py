"""Toxicity, language model, licences, token counts and fingerprints."""

import hashlib
import math
import random
import re
import sys
import zlib

import numpy as np
import pytest

from tallyflow.llm import fingerprints as P
from tallyflow.llm import language_model as L
from tallyflow.llm import licences as C
from tallyflow.llm import token_counts as N
from tallyflow.llm import toxicity as X
from tests.llm.brute import odd_frame, odd_rows, shingles

ROWS = "doc_id long, text string"


def test_toxicity_learns_and_ignores_odd_rows(spark):
    r = random.Random(4)
    mild = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = [r.choice(mild) for _ in range(r.randrange(20, 80))]
        bad = i % 6 == 0
        if bad:
            for _ in range(4):
                text[r.randrange(len(text))] = r.choice(["vile", "grot"]) + r.choice(["ish", "ness", "ling"])
        rows.append((i, " ".join(text)))
        if i // 6 % 2 == 0:
            labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, ROWS)
    marks = spark.createDataFrame(labels + [(3, None), (0, 1)], "doc_id long, toxic int")
    model = X.train(docs, marks)
    got = {x["doc_id"]: x for x in X.score(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == (i % 6 == 0) for i in held]) > 0.97
    odd = odd_frame(spark)
    assert X.drop_toxic(odd, model).schema == odd.schema and X.score(odd, model).count() == odd.count()
    assert all(0 <= x["score"] <= 1 for x in X.score(odd, model).collect())
    nothing = X.train(odd, marks.limit(0))
    assert {x["predicted"] for x in X.score(odd, nothing).collect()} == {0}
    assert X.score(odd.limit(0), model).count() == 0


def brute_base(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]
    counts, n = {}, 0
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            for w in words(t):
                counts[w] = counts.get(w, 0) + 1
                n += 1
    out = {}
    for i, t in rows:
        c = [counts.get(w, 0) for w in words(t)]
        out[i] = (len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 1) / (n + len(counts) + 1)) for x in c))
    return out


@pytest.mark.parametrize("head", [L.HEAD, 50])
def test_language_model(spark, monkeypatch, head):
    monkeypatch.setattr(L, "HEAD", head)
    r = random.Random(8)
    two = [[f"a{i}" for i in range(150)], [f"b{i}" for i in range(150)]]
    rows = [(i, " ".join(r.choice(two[i % 2]) for _ in range(r.randrange(5, 80)))) for i in range(400)]
    rows += [(1000 + (i or 0), t) for i, t, *_ in odd_rows()[:6]]
    docs = spark.createDataFrame(rows, ROWS)
    lexicon, network, counts = L.fit(docs.filter(L.fold("doc_id") != L.HELD_OUT))
    got = {x["doc_id"]: x for x in L.score(docs, lexicon, network, counts).collect()}
    want = brute_base(rows)
    for i, (n, known, train, base) in want.items():
        x = got[i]
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (n, known, train)
        assert abs(x["base_score"] - base) < 1e-6 * max(1, abs(base))
    if head > 50:
        held = [i for i in want if i < 1000 and zlib.crc32(str(i).encode()) % 7 == 2]
        assert sum(got[i]["score"] for i in held) > sum(want[i][3] for i in held)
    assert L.score(docs.limit(0), lexicon, network, counts).count() == 0


def test_language_model_learns_from_all_rows_and_whole_texts(spark):
    ids = spark.range(2400).selectExpr("id as doc_id", "xxhash64(cast(id as string)) as turn").orderBy("turn").collect()
    pattern = " ".join(f"p{i % 10}" for i in range(40))
    rows = [(r["doc_id"], "alone" if i < 2000 else pattern) for i, r in enumerate(ids)]
    rows.append((2400, " ".join(["long"] * 450_000)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon, network, counts = L.fit(docs)
    gain = [r["score"] - r["base_score"] for r in L.score(docs, lexicon, network, counts).collect() if r["n_tokens"] == 41]
    assert len(gain) == 400 and min(gain) > 20  # factor over 3 for every word
    assert network.tokens == lexicon.tokens == 450_001 + 2000 * 2 + 400 * 41


def test_language_model_probabilities_sum_to_one():
    lexicon = L.Lexicon(np.arange(1, 201, dtype=np.uint64), np.arange(300, 100, -1), 10, 60_000, 301, vocabulary=100)
    network = L.Network(lexicon)
    states = np.random.default_rng(1).standard_normal((3, L.HIDDEN)).astype(np.float32)
    for s in states:
        logs = network.log_probabilities(np.repeat(s[None], 102, 0), np.arange(102))
        assert abs(np.exp(logs).sum() - 1) < 1e-4


def test_language_model_slopes_are_those_of_the_loss():
    r = np.random.default_rng(5)
    lexicon = L.Lexicon(np.arange(1, 301, dtype=np.uint64), np.arange(400, 100, -1), 10, 80_000, 401, vocabulary=200)
    network = L.Network(lexicon)
    stream = r.choice([*range(24), 70, 150, 200, 201], (7, 9))  # classes of few and of many rows, texts that end
    given = np.concatenate([np.full((1, 9), 201), stream[:-1]])
    learner = L.Learner(network)
    end = learner.slopes(given, stream, np.zeros((L.HIDDEN, 9), np.float32))

    def loss() -> float:
        net = L.Network(lexicon)
        learner.give(net)
        sigmoid = lambda x: 1 / (1 + np.exp(-x))
        state, states, h = np.zeros((9, L.HIDDEN)), [], L.HIDDEN
        for words in given:
            state = state * (words != 201)[:, None]
            x, back = net.embed[words].astype(float) @ net.wx + net.b, state @ net.wh.astype(float)
            z, reset = sigmoid(x[:, :h] + back[:, :h]), sigmoid(x[:, h : 2 * h] + back[:, h : 2 * h])
            new = np.tanh(x[:, 2 * h :] + reset * back[:, 2 * h :])
            state = new + z * (state - new)
            states.append(state)
        assert np.allclose(end.T, state, atol=1e-5) or not np.array_equal(learner.weights, kept)
        total = net.log_probabilities(np.concatenate(states).astype(np.float32), stream.reshape(-1))
        return -total.mean()

    kept = learner.weights.copy()
    loss()
    largest = np.argsort(-np.abs(learner.slope))
    for i in [*largest[:40], *largest[40:4000:100]]:
        learner.weights[i] = kept[i] + 0.01
        up = loss()
        learner.weights[i] = kept[i] - 0.01
        down = loss()
        learner.weights[i] = kept[i]
        assert abs((up - down) / 0.02 - learner.slope[i]) < 2e-4 + 0.01 * abs(learner.slope[i])


def test_language_model_trains_classes_of_few_words_together():
    words = np.random.default_rng(6).integers(0, L.VOCABULARY, 64 * 96)
    counts = np.arange(20_000, 0, -1)
    network = L.Network(L.Lexicon(np.arange(1, 20_001, dtype=np.uint64), counts, 100, int(counts.sum()) + 100, 20_001))
    calls = []
    sys.setprofile(lambda frame, event, function: event == "c_call" and calls.append(function))
    try:
        network.train([words], len(words))
    finally:
        sys.setprofile(None)
    assert len(calls) / 4 < 600  # a window; 1,266 when the classes went one after another


def test_licences(spark):
    r = random.Random(3)
    rows = [(i, "\n".join(" ".join(r.choice(["ta", "re", "mo", "li", "under", "the", "version"]) for _ in range(12)) for _ in range(5))) for i in range(300)]
    rows += [
        (1000, "Hello\nReleased under the MIT License.\nbye"),
        (1001, "Licensed under the Apache License, Version 2.0."),
        (1002, "This work is licensed under the GNU General Public License, version 3"),
        (1003, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."),
        (1004, "a fishing license is needed"),
        (1005, None),
        (1005, None),
        (None, ""),
    ]
    docs = spark.createDataFrame(rows, ROWS)
    scanner = C.train(docs)
    out = C.licence_scan(docs, scanner).collect()
    got = {x["doc_id"]: x["licences"] for x in out}
    assert len(out) == len(rows)
    assert (got[1000], got[1001], got[1002], got[1003]) == ("mit", "apache", "gpl", "cc,mit")
    assert got[1004] in ("", "unknown") and got[1005] == "" and not any(got[i] for i in range(300))
    assert C.licence_scan(docs.limit(0), scanner).count() == 0


def test_token_counts_of_every_prefix(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    file = public.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(file)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    r = random.Random(3)
    bits = ["a", "b", " ", "  ", "\n", "'", "s", "'ll", "<|endoftext|>", "1", "é", "漢", "!", "-", "The", "ing", " th", "　"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 25))) for _ in range(150)] + ["-" * 70, " " * 90 + "x", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), ROWS)
    for x in N.token_counts(docs, file, keep_prefixes=True).collect():
        text = texts[x["doc_id"]] or ""
        want = [count(text[:i]) for i in range(len(text) + 1)]
        assert N.prefix_counts(x["changes"]).tolist() == want
        assert (x["n_tokens"], x["n_bytes"], x["over_limit"]) == (want[-1], len(text.encode()), want[-1] > 512)
        assert N.tokens_of_prefix(x["changes"], len(text) // 2) == want[len(text) // 2]
        assert N.longest_within(x["changes"], 3) == max(i for i, n in enumerate(want) if n <= 3)


def test_fingerprints(spark):
    r = random.Random(6)
    rows = [(i * 3, " ".join(f"t{r.randrange(500)}" for _ in range(r.randrange(0, 120)))) for i in range(200)]
    rows += [(i + 5000 if i else None, t) for i, t, *_ in odd_rows() if i not in (10,)]
    docs = spark.createDataFrame(rows, ROWS)
    out = P.edited_fingerprints(docs, ranges=3).collect()
    assert len(out) == len(rows)
    of = {x["doc_id"]: x for x in out}
    order = sorted(((-1 if i is None else i, t or "") for i, t in rows), reverse=True)
    errors = []
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        x = of[None if i < 0 else i]
        if [k for k, _ in order].count(i) > 1:
            continue
        new = P.edited(text, after)
        assert x["n_chars"] == len(text) and x["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        a, b = set(shingles(text)), set(shingles(new))
        errors.append(x["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0))
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.06
    same = P.fingerprints(spark.createDataFrame([(1, "a b c d e f"), (2, "A b, c d e f")], ROWS)).collect()
    assert same[0]["fingerprint"] == same[1]["fingerprint"]
    one = P.edited_fingerprints(spark.createDataFrame([(1, "abcdef")], ROWS)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and one["near_next"] == 1.0
    assert P.edited_fingerprints(docs.limit(0)).count() == 0
