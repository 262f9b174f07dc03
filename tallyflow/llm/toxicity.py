"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and a sample of all training texts whatever their label
(U) train a linear classifier on hashed words, word beginnings and word endings.
Its risk on unlabelled text is corrected by the class prior: with loss l,

    prior * mean_P l(+) + max(0, mean_U l(-) - prior * mean_P l(-))

and where the second term gets negative, a step undoes it instead of following it.
The prior is the toxic share of the labelled training rows.

Only the training sample is bounded: at most ``positives`` toxic and ``unlabelled``
other texts, those with the least hash of their id. Every text is scored whole.
Features are the ``FEATURES`` of 2**BITS hash slots that P holds most above U.

Defined results: NULL and empty texts have no features and get the score of the
bias; NULL labels count as no label, of repeated labels the greatest; NULL ids are in no
fold, so such rows are never trained on; without toxic training rows every score is 0;
repeated rows score alike; other columns are kept or not read.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.text import ALNUM, Words, chunks, plain, rebuilt
from tallyflow.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 21
FEATURES = 2048
LEAST_TEXTS = 5  # toxic texts that hold a feature
FOLDS = 5
POSITIVES, UNLABELLED = 10_000, 20_000
BEGINNINGS, ENDINGS = (3, 4, 5, 6), (3, 4)


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash slot of every word, and of its beginnings and endings that are shorter than it."""
    text = np.repeat(np.arange(len(words.first) - 1), words.count)
    length = words.end - words.begin
    texts, slots = [text], [words.hashes()]
    for kind, sizes in ((1, BEGINNINGS), (2, ENDINGS)):
        for size in sizes:
            at = np.flatnonzero(length > size)
            begin = words.begin[at] if kind == 1 else words.end[at] - size
            texts.append(text[at])
            slots.append(words.hashes_of(begin, begin + size) * np.uint64(2 * (16 * kind + size) + 1))
    return np.concatenate(texts), (np.concatenate(slots) >> np.uint64(64 - BITS)).astype(np.int64)


def found(words: Words, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and number of every chosen feature, once for each text."""
    text, slot = features(words)
    number = index[slot]
    at = np.flatnonzero(number >= 0)
    pair = np.unique(text[at] * np.int64(1 << BITS) + number[at].astype(np.int64))
    return pair >> BITS, pair & ((1 << BITS) - 1)


@dataclass
class Classifier:
    index: np.ndarray  # of every hash slot: its feature, or -1
    weights: np.ndarray
    bias: float

    def scores(self, column) -> np.ndarray:
        parts = [np.zeros(0)]
        for a, b, data, offsets in chunks(column):
            text, number = found(Words(data, offsets, ALNUM), self.index)
            margin = self.bias + np.bincount(text, self.weights[number], minlength=b - a)
            parts.append(1 / (1 + np.exp(-np.clip(margin, -60, 60))))
        return np.concatenate(parts)


def nn_pu(
    number: np.ndarray, row: np.ndarray, is_p: np.ndarray, size: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4
) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk (logistic loss, Adam over all rows).

    ``number`` lists the features of all rows one after the other, ``row`` whose each is.
    """
    rows, p = len(is_p), int(is_p.sum())
    is_u = ~is_p
    weights, bias = np.zeros(size), np.log(prior / (1 - prior))
    state = np.zeros((2, size + 1))
    for step in range(1, steps + 1):
        margin = bias + np.bincount(row, weights[number], minlength=rows)
        toxic = 1 / (1 + np.exp(-np.clip(margin, -60, 60)))
        loss_as_clean = np.logaddexp(0, margin)
        negative = loss_as_clean[is_u].mean() - prior * loss_as_clean[is_p].mean() if p < rows else 0.0
        slope = np.zeros(rows)
        if negative >= 0:
            slope[is_p] = -prior / p
            slope[is_u] = toxic[is_u] / max(rows - p, 1)
        else:
            slope[is_p] = prior * toxic[is_p] / p
            slope[is_u] = -toxic[is_u] / max(rows - p, 1)
        gradient = np.append(np.bincount(number, slope[row], minlength=size) + decay * weights, slope.sum())
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.999 * state[1] + 0.001 * gradient**2
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        weights -= move[:-1]
        bias -= move[-1]
    return weights, float(bias)


def fold(id: str) -> Column:
    return F.crc32(F.col(id).cast("string").cast("binary")) % FOLDS


def _least(turn: Column, want: int, total: int) -> Column:
    """Whether a hash is among somewhat more than the ``want`` least of ``total``: a cut before a sort, so that a task
    of the sort holds its share of the sample and not the whole."""
    share = (1.3 * want + 1000) / max(total, 1)
    return F.lit(True) if share >= 1 else turn <= F.lit(int(share * 2**64) - 2**63)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
) -> Classifier:
    """Learn from the rows outside fold 0."""
    ids = labels.select(F.col(id).alias("id"), F.col(label).alias("toxic"))
    ids = ids.filter(fold("id") != 0).groupBy("id").agg(F.max("toxic").alias("toxic")).filter("toxic is not null")
    ids = ids.join(docs.select(F.col(id).alias("id")).distinct(), "id", "left_semi")
    total = ids.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("p")).first()
    nothing = Classifier(np.full(1 << BITS, -1, np.int16), np.zeros(1), -60.0)
    if not total["p"]:
        return nothing
    prior = min(max(total["p"] / total["n"], 1e-4), 0.5)
    turn = F.xxhash64("id")
    toxic = ids.filter("toxic = 1").filter(_least(turn, positives, total["p"]))
    toxic = toxic.select("id", F.lit(1).alias("p")).orderBy(turn).limit(positives)
    other = F.xxhash64("id", F.lit(1))
    training = docs.select(F.col(id).alias("id")).filter(fold("id") != 0)
    any_ = training.filter(_least(other, unlabelled, training.agg(F.approx_count_distinct("id")).first()[0])).distinct()
    any_ = any_.select("id", F.lit(0).alias("p")).orderBy(other).limit(unlabelled)
    chosen = toxic.union(any_)  # at most positives + unlabelled ids, so it may be broadcast
    sample = materialize(
        docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("p", "text"), "toxicity"
    )

    def tally(only: np.ndarray | None):
        def run(batches):
            count = np.zeros(1 << BITS, np.int64)
            for batch in batches:
                for _, _, data, offsets in chunks(batch.column(0)):
                    text_, slot = features(Words(data, offsets, ALNUM))
                    if only is not None:
                        at = only[slot]
                        text_, slot = text_[at], slot[at]
                    slot, texts = np.unique(np.unique(text_ << BITS | slot) & ((1 << BITS) - 1), return_counts=True)
                    count[slot] += texts
            slot = np.flatnonzero(count)
            for a in range(0, len(slot), 100_000):
                part = slot[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(count[part])], ["slot", "n"])

        return run

    def counted(p: int, only: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray]:
        parts = sample.filter(F.col("p") == p).select("text").mapInArrow(tally(only), "slot long, n long")
        got = parts.groupBy("slot").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow()  # at most 2**BITS rows
        return got.column("slot").to_numpy(), got.column("n").to_numpy()

    slot, n_p = counted(1, None, LEAST_TEXTS)
    if not len(slot):
        return nothing
    only = np.zeros(1 << BITS, bool)
    only[slot] = True
    place = np.argsort(slot)
    slot, n_p, n_u = slot[place], n_p[place], np.zeros(len(slot))
    slot_u, many = counted(0, only, 1)
    n_u[np.searchsorted(slot, slot_u)] = many
    sizes = {r["p"]: r["count"] for r in sample.groupBy("p").count().collect()}
    share_p, share_u = n_p / sizes[1], (n_u + 1) / (sizes.get(0, 0) + 2)
    # How far P's share lies above U's, in standard errors of a share this small.
    excess = (share_p - share_u) / np.sqrt(share_u * (1 - np.minimum(share_u, 0.999)) / sizes[1] + 1e-12)
    order = np.lexsort((slot, -excess))[:FEATURES]
    order = order[excess[order] > 0]
    index = np.full(1 << BITS, -1, np.int16)
    index[slot[order]] = np.arange(len(order))

    def rows(batches):
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                text_, number = found(Words(data, offsets, ALNUM), index)
                ends = np.searchsorted(text_, np.arange(b - a + 1)).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(ends), pa.array(number.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), held], ["p", "held"])

    table = sample.mapInArrow(rows, "p int, held array<int>").toArrow()  # a row for each text of the sample
    lists = table.column("held").combine_chunks()
    number, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    weights, bias = nn_pu(number, np.repeat(np.arange(len(size)), size), table.column("p").to_numpy() == 1, max(len(order), 1), prior)
    return Classifier(index, weights, bias)


def score(docs: DataFrame, model: Classifier, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``id``, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on)."""
    sent = docs.sparkSession.sparkContext.broadcast(plain(model))
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        classifier = rebuilt(Classifier, sent.value)
        for batch in batches:
            value = classifier.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], ["id", "score", "predicted"]
            )

    rows = docs.select(F.col(id).alias("id"), text).mapInArrow(run, f"id {kind}, score double, predicted int")
    return rows.withColumnRenamed("id", id)


def drop_toxic(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """The documents that are not predicted toxic; same columns."""
    sent = docs.sparkSession.sparkContext.broadcast(plain(model))
    place = docs.columns.index(text)

    def run(batches):
        classifier = rebuilt(Classifier, sent.value)
        for batch in batches:
            yield batch.filter(pa.array(classifier.scores(batch.column(place)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
