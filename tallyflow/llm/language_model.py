"""Gated recurrent language model with class-factored output, scored over whole documents.

Words are runs without white space, A-Z lowered, and one end token closes each text.
All training texts are counted. The ``HEAD`` commonest words go to every task with their
counts; counts of rarer words stay in a table and meet the documents' rare words in a
join. The ``VOCABULARY`` commonest words are what the network can tell apart, in classes
of ``CLASS`` words of like frequency; one class holds all other words, one the end.

    P(word) = P(class | state) * P(word | class, state)

Within the class of other words the share is (count + 1) over the sum of these and one
unseen word. The network is a gated recurrent unit trained by truncated
backpropagation through time in NumPy on all texts, whole: in each epoch every task trains a
copy on its own texts, piece after piece, and the next epoch begins with the copies' mean, weighted by
tokens. Tasks get ``SHARE`` tokens or more. Its biases start from the counts. When scoring, lanes
of documents run side by side in windows; the state is carried from window to window
and begins anew with each document.

Defined results: NULL and empty texts are their end token; rows with a NULL id are
scored and not learned from; repeated rows are counted and scored each; without training rows the
counts are 0; other columns are not read; an empty table gives an empty one. Words are told by 64-bit hashes.
"""

from __future__ import annotations

import copy
import heapq
import sys
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.text import NOT_SPACE, Words, chunks, plain, rebuilt
from tallyflow.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEAD = 1 << 18
VOCABULARY, CLASS = 8192, 64
SHARE = 400_000  # least tokens of a training task
PIECE, SLOT = 1_000_000, 16_384  # tokens cut into lanes together; weights in one row of a sum
HIDDEN = 16
LANES, WINDOW = 256, 64
TRAIN_LANES, TRAIN_WINDOW, EPOCHS, RATE = 64, 24, 2, 0.01
ROWS, BLOCK = 2048, 16_384  # states scored, weights moved at once: what a core's cache holds
FEW = 8  # rows of a class that go with others in one product
HALF = np.float32(0.5)
FOLDS, HELD_OUT = 7, 2


def fold(id: str) -> Column:
    return F.crc32(F.col(id).cast("string").cast("binary")) % FOLDS


class Lexicon:
    """Counts of the commonest words, by hash, and what is known of all words."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, texts: int, tokens: int, distinct: int, vocabulary: int = VOCABULARY):
        rank = np.lexsort((hashes, -counts))
        self.words = min(vocabulary, len(hashes))
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        place = np.empty(len(hashes), np.int64)
        place[rank] = np.arange(len(hashes))
        self.rank = np.minimum(place[order], self.words).astype(np.int32)  # ``words``: any other word
        self.top = counts[rank[: self.words]]
        self.texts, self.tokens, self.distinct = texts, tokens, distinct
        common = int(self.top.sum())
        self.other = (tokens - texts - common) + (distinct - bool(texts) - self.words)  # sum of count + 1
        self.log_other = np.log10(self.other + 1.0)
        self.log_all = np.log10(tokens + distinct + 1.0)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Network's word number and count of each word; count -1: not among the commonest."""
        if not len(self.hashes):
            return np.full(len(hashes), self.words, np.int32), np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes
        return np.where(hit, self.rank[at], self.words).astype(np.int32), np.where(hit, self.counts[at], -1)


def _sigmoid_of_half(x: np.ndarray) -> np.ndarray:
    """sigmoid(2 x), in place."""
    np.tanh(x, out=x)
    x *= HALF
    x += HALF
    return x


class Network:
    """Word numbers: 0 .. words - 1, words (any other word), words + 1 (end, and what precedes a text)."""

    def __init__(self, lexicon: Lexicon, hidden: int = HIDDEN, seed: int = 11):
        draw = np.random.default_rng(seed)
        n, h = lexicon.words, hidden
        self.words, self.hidden = n, h
        self.blocks = -(-n // CLASS)
        small = lambda *shape: (draw.standard_normal(shape) * 0.1).astype(np.float32)
        self.embed, self.wx, self.wh = small(n + 2, h), small(h, 3 * h) * 3, small(h, 3 * h) * 3
        self.b = np.zeros(3 * h, np.float32)
        self.uc, self.ui = small(h, self.blocks + 2) * 0.1, small(self.blocks, CLASS, h) * 0.1
        weight = np.zeros(self.blocks * CLASS)
        weight[:n] = lexicon.top + 1.0
        weight = weight.reshape(self.blocks, CLASS)
        mass = np.append(weight.sum(1), [lexicon.other + 1.0, lexicon.texts + 1.0])
        self.bc = np.log(mass / mass.sum()).astype(np.float32)
        with np.errstate(divide="ignore"):
            self.bi = np.maximum(np.log(weight / np.maximum(weight.sum(1, keepdims=True), 1)), -1e4).astype(np.float32)

    PARTS = ("embed", "wx", "wh", "b", "uc", "bc", "ui", "bi")

    def classes(self, words: np.ndarray) -> np.ndarray:
        return np.where(words < self.words, words // CLASS, self.blocks + words - self.words)

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the classes and of the words in each class, the biases as a last input."""
        return np.vstack([self.uc, self.bc]), np.concatenate([self.ui, self.bi[..., None]], 2)

    def log_probabilities(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logs of the class-factored probabilities of targets after states."""
        outer, within = self._tables()
        classes = self.classes(targets).astype(np.int16)
        order = np.argsort(classes, kind="stable")
        ends = np.searchsorted(classes[order], np.arange(self.blocks + 1))
        states = np.concatenate([states, np.ones((len(states), 1), np.float32)], 1)[order]
        targets, classes = targets[order], classes[order]
        logs, sums = np.empty(len(order), np.float32), np.empty(len(order), np.float32)
        ones = np.ones(max(outer.shape[1], CLASS), np.float32)
        for a in range(0, len(order), ROWS):
            logits = states[a : a + ROWS] @ outer
            logs[a : a + ROWS] = logits[np.arange(len(logits)), classes[a : a + ROWS]]
            np.exp(logits, out=logits)
            np.dot(logits, ones[: outer.shape[1]], out=sums[a : a + ROWS])
        total = logs - np.log(sums.astype(np.float64))
        last = ends[self.blocks]
        inside = targets[:last] - classes[:last] * CLASS
        for c in range(self.blocks):
            for a in range(ends[c], ends[c + 1], ROWS):
                b = min(a + ROWS, ends[c + 1])
                inner = states[a:b] @ within[c].T
                logs[a:b] = inner[np.arange(b - a), inside[a:b]]
                np.exp(inner, out=inner)
                np.dot(inner, ones[:CLASS], out=sums[a:b])
        total[:last] += logs[:last] - np.log(sums[:last].astype(np.float64))
        out = np.empty(len(order))
        out[order] = total
        return out

    def weights(self) -> np.ndarray:
        return np.concatenate([getattr(self, p).ravel() for p in self.PARTS])

    def put(self, weights: np.ndarray) -> None:
        at = 0
        for p in self.PARTS:
            old = getattr(self, p)
            setattr(self, p, weights[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def train(self, pieces: Iterable[np.ndarray], share: float, epoch: int = 0, epochs: int = EPOCHS) -> int:
        """One epoch of truncated backpropagation through time (Adam); the tokens learned from.

        Each piece, joined texts with their end tokens, is cut into lanes; what is left over is a lane of
        its own. ``share`` tokens are expected, by which the rate falls.
        """
        end = self.words + 1
        learner = Learner(self)
        done = 0
        for piece in pieces:
            lanes = min(TRAIN_LANES, max(1, len(piece) // (4 * TRAIN_WINDOW)))
            whole = len(piece) // lanes * lanes
            for part, lanes in ((piece[:whole], lanes), (piece[whole:], 1)):  # noqa: B020, PLW2901
                stream = part.reshape(lanes, -1).T
                given = np.concatenate([np.full((1, lanes), end), stream[:-1]])
                state = np.zeros((self.hidden, lanes), np.float32)
                for a in range(0, len(stream), TRAIN_WINDOW):
                    state = learner.slopes(given[a : a + TRAIN_WINDOW], stream[a : a + TRAIN_WINDOW], state)
                    learner.move(RATE * (1 - 0.9 * (epoch + min(1.0, done / max(share, 1.0))) / epochs))
                    done += stream[a : a + TRAIN_WINDOW].size
        learner.give(self)
        return done

    def score(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log-likelihood of each text: its words, then the end."""
        end, texts = self.words + 1, len(first) - 1
        sizes = np.diff(first) + 1
        lanes = min(LANES, texts)
        if not texts:
            return np.zeros(0)
        loads, of_lane = [(0, i) for i in range(lanes)], [[] for _ in range(lanes)]
        for t in np.argsort(-sizes, kind="stable").tolist():
            load, lane = heapq.heappop(loads)
            of_lane[lane].append(t)
            heapq.heappush(loads, (load + int(sizes[t]), lane))
        lengths = np.array([int(sizes[x].sum()) for x in of_lane])
        order = np.argsort(-lengths, kind="stable")
        lengths, longest = lengths[order], int(lengths.max())
        spot = np.zeros(lanes, np.int64)
        streams = []
        for lane in order.tolist():
            parts, owners = [], []
            for t in of_lane[lane]:
                parts += [words[first[t] : first[t + 1]], [end]]
                owners.append(t)
            streams.append((np.concatenate(parts).astype(np.int32), np.repeat(owners, sizes[owners]).astype(np.int32)))
        h = self.hidden
        halves = np.repeat(np.array([0.5, 0.5, 1], np.float32), h)  # of the gates, see Learner
        before = (self.embed @ self.wx + self.b) * halves  # input part of the gates, by word
        back = np.ascontiguousarray((self.wh * halves).T)
        out = np.zeros(texts)
        state = np.zeros((h, lanes), np.float32)
        previous = np.full(lanes, end, np.int32)
        for a in range(0, longest, WINDOW):
            active = int(np.searchsorted(-lengths, -a, "left"))  # lanes longer than a
            steps = min(WINDOW, longest - a)
            goal = np.full((steps, active), -1, np.int32)
            owner = np.zeros((steps, active), np.int32)
            for lane in range(active):
                tokens, owners = streams[lane]
                part = tokens[a : a + steps]
                goal[: len(part), lane] = part
                owner[: len(part), lane] = owners[a : a + steps]
            given = np.concatenate([previous[None, :active], np.maximum(goal[:-1], 0)])
            states = np.empty((steps, active, h), np.float32)
            now = np.ascontiguousarray(state[:, :active])
            fresh = given == end
            resets = fresh.any(1)
            for t in range(steps):
                if resets[t]:
                    now = now * ~fresh[t]
                x, known = before[given[t]].T, back @ now
                gates = _sigmoid_of_half(x[: 2 * h] + known[: 2 * h])
                known = known[2 * h :]
                known *= gates[h:]
                known += x[2 * h :]
                new = np.tanh(known, out=known)
                now -= new
                now *= gates[:h]
                now += new
                states[t] = now.T
            state[:, :active], previous[:active] = now, goal[-1]
            real = np.flatnonzero(goal.reshape(-1) >= 0)
            logs = self.log_probabilities(states.reshape(-1, h)[real], goal.reshape(-1)[real])
            out += np.bincount(owner.reshape(-1)[real], logs, minlength=texts)
        return out


class Learner:
    """Weights, slopes and moments of a network in one flat array each; a step of Adam moves them all in place.

    In a window lanes are columns, so the gates of all lanes are whole rows; words are sorted by class, so
    each class is one product of matrices. The first two gates are taken at half their input:
    sigmoid(x) = (1 + tanh(x / 2)) / 2.
    """

    def __init__(self, net: Network):
        outer, within = net._tables()
        start = {"embed": net.embed, "wx": net.wx, "wh": net.wh, "b": net.b, "outer": outer, "within": within}
        size = sum(x.size for x in start.values())
        self.weights, self.slope, self.first, self.second = np.zeros((4, size), np.float32)
        self.w, self.g, at = {}, {}, 0
        for name, x in start.items():
            self.w[name] = self.weights[at : at + x.size].reshape(x.shape)
            self.g[name] = self.slope[at : at + x.size].reshape(x.shape)
            self.w[name][...] = x
            at += x.size
        self.hidden, self.blocks, self.end, self.turn = net.hidden, net.blocks, net.words + 1, 0
        self.class_of = net.classes(np.arange(net.words + 2)).astype(np.int16)
        self.halves = np.repeat(np.array([0.5, 0.5, 1], np.float32), net.hidden)
        self.spare = np.empty((2, BLOCK), np.float32)
        self.stack = [np.empty((net.blocks, FEW, k), np.float32) for k in (net.hidden + 1, net.hidden + 1, CLASS)]

    def give(self, net: Network) -> None:
        for name in ("embed", "wx", "wh", "b"):
            setattr(net, name, self.w[name].copy())
        net.uc, net.bc = self.w["outer"][:-1].copy(), self.w["outer"][-1].copy()
        net.ui, net.bi = self.w["within"][..., :-1].copy(), self.w["within"][..., -1].copy()

    def move(self, rate: float) -> None:
        """One step of Adam, with the slopes cut to a norm of 1."""
        self.turn += 1
        norm = float(np.sqrt(np.dot(self.slope, self.slope)))
        cut = min(1.0, 1.0 / (norm + 1e-9))
        even = np.sqrt(1 - 0.99**self.turn)
        pace, least = np.float32(rate * even / (1 - 0.9**self.turn)), np.float32(1e-6 * even)
        for a in range(0, len(self.weights), BLOCK):
            g, m, v = self.slope[a : a + BLOCK], self.first[a : a + BLOCK], self.second[a : a + BLOCK]
            one, two = self.spare[0, : len(g)], self.spare[1, : len(g)]
            np.multiply(g, np.float32(0.1 * cut), out=one)
            m *= np.float32(0.9)
            m += one
            np.multiply(one, one, out=one)
            v *= np.float32(0.99)
            v += one  # 0.1 squared is 0.01
            np.sqrt(v, out=two)
            two += least
            np.divide(m, two, out=two)
            two *= pace
            self.weights[a : a + BLOCK] -= two

    def slopes(self, given: np.ndarray, targets: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Sets the slopes of the mean loss of a window; the state after it."""
        w, g, h = self.w, self.g, self.hidden
        (steps, lanes), m = given.shape, given.size
        by_lane = lambda x: np.ascontiguousarray(x.reshape(steps, lanes, -1).transpose(0, 2, 1))
        by_row = lambda x: x.transpose(0, 2, 1).reshape(m, -1)
        words = given.reshape(-1)
        keep = (given != self.end).astype(np.float32)
        resets = (keep.min(1) == 0).tolist()
        x = w["embed"][words]
        xs = by_lane((x @ w["wx"] + w["b"]) * self.halves)
        recur = np.ascontiguousarray((w["wh"] * self.halves).T)
        back, gates = np.empty((steps, 3 * h, lanes), np.float32), np.empty((steps, 2 * h, lanes), np.float32)
        news, states, befores = np.empty((3, steps, h, lanes), np.float32)
        befores[0] = state
        for t, (x_gate, x_new, known, new, now, gate) in enumerate(zip(xs[:, : 2 * h], xs[:, 2 * h :], back, news, states, gates)):
            if resets[t]:
                state = state * keep[t]
            np.dot(recur, state, out=known)
            np.add(x_gate, known[: 2 * h], out=gate)
            _sigmoid_of_half(gate)
            np.multiply(gate[h:], known[2 * h :], out=new)
            new += x_new
            np.tanh(new, out=new)
            np.subtract(state, new, out=now)
            now *= gate[:h]
            now += new
            state = now
        befores[1:] = states[:-1]
        befores *= keep[:, None]
        flat = np.ones((m, h + 1), np.float32)
        flat[:, :h] = by_row(states)
        dh = by_lane(self._outputs(flat, targets.reshape(-1)))
        z, r = gates[:, :h], gates[:, h:]
        rest = 1 - z
        to_new = rest * (1 - news * news)
        to_z = (befores - news) * z * rest
        to_r = back[:, 2 * h :] * r * (1 - r)
        into, dn = np.empty((steps, 3 * h, lanes), np.float32), np.empty((steps, h, lanes), np.float32)
        carry = np.zeros((h, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            d, dnew, flow = dh[t], dn[t], into[t]
            d += carry
            np.multiply(d, to_z[t], out=flow[:h])
            np.multiply(d, to_new[t], out=dnew)
            np.multiply(dnew, to_r[t], out=flow[h : 2 * h])
            np.multiply(dnew, r[t], out=flow[2 * h :])
            np.dot(w["wh"], flow, out=carry)
            d *= z[t]
            carry += d
            if resets[t]:
                carry *= keep[t]
        two = by_row(into)
        np.dot(befores.transpose(1, 0, 2).reshape(h, m), two, out=g["wh"])
        two[:, 2 * h :] = by_row(dn)
        np.dot(x.T, two, out=g["wx"])
        np.dot(np.ones(m, np.float32), two, out=g["b"])
        order = np.argsort(words.astype(np.uint16) if self.end < 1 << 16 else words, kind="stable")
        sorted_words = words[order]
        starts = np.flatnonzero(np.append(True, sorted_words[1:] != sorted_words[:-1]))
        g["embed"][...] = 0
        g["embed"][sorted_words[starts]] = np.add.reduceat((two @ w["wx"].T)[order], starts, axis=0)
        return state

    def _outputs(self, flat: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """Slopes of the classes, of the words in them, and of the states (returned)."""
        w, g, h, m = self.w, self.g, self.hidden, len(goal)
        classes = self.class_of[goal]
        order = np.argsort(classes, kind="stable")
        flat, goal, classes = flat[order], goal[order], classes[order]
        ends = np.searchsorted(classes, np.arange(self.blocks + 1)).tolist()
        rows = np.arange(m)
        ds = self._softmax(flat @ w["outer"], rows, classes, m)
        np.dot(flat.T, ds, out=g["outer"])
        ds = ds @ w["outer"][:h].T
        last = ends[-1]
        # Classes of few rows go as one stack with places for FEW rows each, the others one after another.
        many = [(c, a, b) for c, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b - a > FEW]
        size = np.diff(ends)
        few = np.flatnonzero(np.repeat(size <= FEW, size))
        place = classes[few].astype(np.int64) * FEW + few - np.array(ends)[classes[few]]
        inner, within = np.empty((last, CLASS), np.float32), w["within"]
        given, more, slopes = self.stack
        given[...] = 0
        given.reshape(-1, h + 1)[place] = flat[few]
        np.matmul(given, within.transpose(0, 2, 1), out=slopes)
        inner[few] = slopes.reshape(-1, CLASS)[place]
        for c, a, b in many:
            np.dot(flat[a:b], within[c].T, out=inner[a:b])
        inner = self._softmax(inner, rows[:last], goal[:last] - classes[:last].astype(np.int64) * CLASS, m)
        slopes[...] = 0
        slopes.reshape(-1, CLASS)[place] = inner[few]
        np.matmul(slopes.transpose(0, 2, 1), given, out=g["within"])
        np.matmul(slopes, within, out=more)
        back = np.empty((last, h + 1), np.float32)
        back[few] = more.reshape(-1, h + 1)[place]
        for c, a, b in many:
            np.dot(inner[a:b].T, flat[a:b], out=g["within"][c])
            np.dot(inner[a:b], within[c], out=back[a:b])
        ds[:last] += back[:, :h]
        out = np.empty_like(ds)
        out[order] = ds
        return out

    @staticmethod
    def _softmax(logits: np.ndarray, rows: np.ndarray, goal: np.ndarray, m: int) -> np.ndarray:
        """Slopes of the mean loss over ``m`` rows by the logits, which are overwritten."""
        if logits.size and logits.max() > 60:
            logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        sums = logits @ np.ones(logits.shape[1], np.float32)
        logits *= (1 / (sums * np.float32(m)))[:, None]
        logits[rows, goal] -= np.float32(1 / m)
        return logits


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word`` (hash) and ``count`` over all rows."""

    def run(batches):
        for batch in batches:
            parts = [np.zeros(0, np.uint64)]
            for _, _, data, offsets in chunks(batch.column(0)):
                parts.append(Words(data, offsets, NOT_SPACE).hashes())
            word, count = np.unique(np.concatenate(parts), return_counts=True)
            for a in range(0, len(word), 200_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word[a : a + 200_000].view(np.int64)), pa.array(count[a : a + 200_000])], ["word", "count"]
                )

    return docs.select(text).mapInArrow(run, "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[Lexicon, Network, DataFrame]:
    """Count the rows of ``docs`` and train on them; also the table of all counts."""
    counts = materialize(count_words(docs, text), "counts")
    total = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("count").alias("n")).first()
    texts = docs.count()
    head = counts.orderBy(F.desc("count"), "word").limit(HEAD).toArrow()
    lexicon = Lexicon(
        head.column("word").to_numpy().astype(np.int64).view(np.uint64),
        head.column("count").to_numpy().astype(np.int64),
        texts,
        (total["n"] or 0) + texts,
        total["v"] + bool(texts),
    )
    sent = docs.sparkSession.sparkContext.broadcast(plain(lexicon))

    network = Network(lexicon)
    learned = docs.filter(F.col(id).isNotNull()).select(text)
    learned = learned.coalesce(max(1, lexicon.tokens // SHARE))
    share = lexicon.tokens / max(1, learned.rdd.getNumPartitions())
    for epoch in range(EPOCHS):
        network = _epoch(learned, sent, network, share, epoch)
    return lexicon, network, counts


def _pieces(batches, lexicon: Lexicon) -> Iterable[np.ndarray]:
    """Word numbers of all texts with their end tokens, about ``PIECE`` at a time."""
    held, size = [], 0
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column(0)):
            words = Words(data, offsets, NOT_SPACE)
            numbers = lexicon.look_up(words.hashes())[0]
            held.append(np.insert(numbers, words.first[1:], lexicon.words + 1))
            size += len(held[-1])
            if size >= PIECE:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _epoch(texts: DataFrame, lexicon, network: Network, share: float, epoch: int) -> Network:
    """The mean of the networks that the tasks make of ``network``, weighted by their tokens."""
    sent = texts.sparkSession.sparkContext.broadcast(plain(network))

    def run(batches):
        net = rebuilt(Network, copy.deepcopy(sent.value))
        done = net.train(_pieces(batches, rebuilt(Lexicon, lexicon.value)), share, epoch)
        if done:
            weights = net.weights().astype(np.float64) * done
            slots = [weights[a : a + SLOT].tobytes() for a in range(0, len(weights), SLOT)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(slots), dtype=np.int32)), pa.array([done] * len(slots), pa.int64()), pa.array(slots, pa.binary())],
                ["slot", "tokens", "weights"],
            )

    def total(table):
        out = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("weights"))
        tokens = sum(table.column("tokens").to_pylist())
        return pa.table({"slot": table.column("slot")[:1], "tokens": pa.array([tokens], pa.int64()), "weights": pa.array([out.tobytes()], pa.binary())})

    schema = "slot int, tokens long, weights binary"
    rows = sorted(texts.mapInArrow(run, schema).groupBy("slot").applyInArrow(total, schema).collect(), key=lambda r: r["slot"])
    mean = copy.deepcopy(network)
    if rows:
        mean.put(np.concatenate([np.frombuffer(r["weights"], np.float64) / r["tokens"] for r in rows]))
    mean.tokens = rows[0]["tokens"] if rows else 0
    return mean


def score(
    docs: DataFrame, lexicon: Lexicon, network: Network, counts: DataFrame, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: ``id, n_tokens, n_known, train_tokens, base_score, score`` (log10)."""
    sent = docs.sparkSession.sparkContext.broadcast((plain(lexicon), plain(network)))
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        words_known, net = rebuilt(Lexicon, sent.value[0]), rebuilt(Network, sent.value[1])
        end_log = np.log10(words_known.texts + 1.0)
        for batch in batches:
            numbers, first, at = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
            known, base, others, other_logs, rare = [], [], [], [], []
            for a, b, data, offsets in chunks(batch.column(1)):
                words = Words(data, offsets, NOT_SPACE)
                hashes = words.hashes()
                number, count = words_known.look_up(hashes)
                owner = np.repeat(np.arange(b - a), words.count)
                total = lambda w: np.bincount(owner, w, minlength=b - a)  # noqa: B023, E731
                logs = np.where(count >= 0, np.log10(np.maximum(count, 0) + 1.0), 0.0)
                known.append(total(count > 0))
                base.append(total(logs))
                other = number == words_known.words
                others.append(total(other))
                other_logs.append(total(np.where(other, logs, 0.0)))
                absent = np.flatnonzero(count < 0)
                cut = np.searchsorted(owner[absent], np.arange(b - a + 1))
                rare += [hashes[absent[i:j]].view(np.int64) for i, j in zip(cut[:-1], cut[1:])]
                numbers.append(number)
                first.append(words.first[1:] + at)
                at += len(hashes)
            n = len(batch)
            if not n:
                continue
            cat = lambda x: np.concatenate(x)
            start = cat(first)
            natural = net.score(cat(numbers), start)
            size = np.diff(start) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(size.astype(np.int64)),
                    pa.array(cat(known).astype(np.int64) + bool(words_known.texts)),
                    pa.array(cat(base) + end_log - size * words_known.log_all),
                    pa.array(natural / np.log(10) + cat(other_logs) - cat(others) * words_known.log_other),
                    pa.array(rare, pa.list_(pa.int64())),
                ],
                ["id", "n_tokens", "n_known", "base", "model", "rare"],
            )

    schema = f"id {kind}, n_tokens long, n_known long, base double, model double, rare array<bigint>"
    rows = docs.select(F.col(id).alias("id"), text).mapInArrow(run, schema)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    # Words outside the commonest: their counts, if any, come from the table.
    rare = rows.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("times"))
    more = (
        rare.join(counts, "word")
        .groupBy("row")
        .agg(F.sum("times").alias("found"), F.sum(F.col("times") * F.log10(F.col("count") + 1)).alias("logs"))
    )
    logs = F.coalesce("logs", F.lit(0.0))
    return rows.drop("rare").join(more, "row", "left").select(
        F.col("id").alias(id),
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(int(lexicon.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )
