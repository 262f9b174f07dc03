"""Support vector machines of all folds and classes, fitted together.

One machine tells one class from the rest and learns from all folds but one; the folds x classes machines are the
columns of one weight matrix. An iteration is one pass over the narrow feature table: every task makes
the random cosine features of its rows, and adds up the gradients of all machines at the trial point and their losses at
several steps towards it. Tasks send one array each, whose size is features x machines, and a
second level of tasks adds those up, so the driver sees few of them whatever the number of rows. The
search itself (limited-memory quasi-Newton, per machine) is on the driver, on arrays of that size.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.operators.neighbors import usable
from tallyflow.schemas import FEATURES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SMOOTH = 0.1  # the hinge is rounded off over this width, so that it has a gradient
STEPS = np.array([1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001])
ROWS = 4096
MEMORY = 10
WIDE = 32  # arrays that the driver adds up itself


@dataclass
class Waves:
    """Random cosine features, whose inner product approximates the RBF kernel, and a constant."""

    directions: np.ndarray
    shifts: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        count = len(self.shifts)
        out = np.ones((len(x), count + 1))
        np.cos(x @ self.directions.T + self.shifts, out=out[:, :count])
        out[:, :count] *= math.sqrt(2 / count)
        return out


def fit_waves(df: DataFrame, count: int, seed: int) -> Waves:
    """The kernel width is one over (features x variance of all values)."""
    stats = df.agg(
        *[F.avg(f).alias(f"m_{f}") for f in FEATURES],
        *[F.var_pop(f).alias(f"v_{f}") for f in FEATURES],
    ).first()
    means = np.array([stats[f"m_{f}"] for f in FEATURES])
    variance = float(np.mean([stats[f"v_{f}"] for f in FEATURES]) + means.var())
    gamma = 1.0 / (len(FEATURES) * variance) if variance > 0 else 1.0
    rng = np.random.default_rng(seed)
    return Waves(rng.normal(scale=math.sqrt(2 * gamma), size=(count, len(FEATURES))), rng.uniform(0, 2 * math.pi, size=count))


def rounded_hinge(short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and slope where a margin falls ``short`` of 1."""
    slope = np.clip(short / SMOOTH, 0.0, 1.0)
    return slope * (short - 0.5 * SMOOTH * slope), slope


def losses_and_gradient(
    z: np.ndarray, label: np.ndarray, fold: np.ndarray, weights: np.ndarray, step: np.ndarray, folds: int, classes: int
) -> tuple[np.ndarray, np.ndarray]:
    """Sums over rows of the losses at every step and of the gradient at the whole step, per machine (fold-major)."""
    sign = np.where(label[:, None] == np.arange(classes), 1.0, -1.0)
    learns = fold[:, None] != np.arange(folds)
    sign = (learns[:, :, None] * sign[:, None, :]).reshape(len(z), -1)  # 0: the row is not this machine's
    here, change = sign * (z @ weights), sign * (z @ step)
    mine = sign != 0
    losses = np.empty((len(STEPS), sign.shape[1]))
    for i, t in enumerate(STEPS):
        loss, slope = rounded_hinge(1.0 - here - t * change)
        losses[i] = (loss * mine).sum(axis=0)
        if t == 1.0:
            gradient = -z.T @ (slope * sign)
    return losses, gradient


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES])


def _sums(points: DataFrame, waves: Waves, weights: np.ndarray, step: np.ndarray, folds: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """One pass: losses (steps x machines) and gradient (features x machines) over all rows."""
    sent = points.sparkSession.sparkContext.broadcast((waves.directions, waves.shifts, weights, step))
    shape = (len(STEPS) + weights.shape[0], weights.shape[1])

    def add_rows(batches):
        directions, shifts, w, d = sent.value
        total = np.zeros(shape)
        for batch in batches:
            for begin in range(0, len(batch), ROWS):
                part = batch.slice(begin, ROWS)
                label, fold = (part.column(c).to_numpy() for c in ("label", "fold"))
                losses, gradient = losses_and_gradient(Waves(directions, shifts)(_matrix(part)), label, fold, w, d, folds, classes)
                total[: len(STEPS)] += losses
                total[len(STEPS) :] += gradient
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add_arrays(batches):
        total = np.zeros(shape)
        for batch in batches:
            for held in batch.column("sums").to_pylist():
                total += np.frombuffer(held).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    arrays = points.mapInArrow(add_rows, "sums binary")
    tasks = points.rdd.getNumPartitions()
    if tasks > WIDE:
        arrays = arrays.repartition(math.isqrt(tasks)).mapInArrow(add_arrays, "sums binary")
    total = np.sum([np.frombuffer(r["sums"]).reshape(shape) for r in arrays.collect()], axis=0)
    sent.destroy()
    return total[: len(STEPS)], total[len(STEPS) :]


class Search:
    """Limited-memory quasi-Newton steps for many machines at a time (the columns)."""

    def __init__(self):
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def remember(self, moved: np.ndarray, turned: np.ndarray) -> None:
        """Moves and changes of the gradient; a machine that did not move has zeros."""
        along = (moved * turned).sum(axis=0)
        useful = along > 1e-12
        self.pairs.append((moved, turned, np.where(useful, 1.0 / np.where(useful, along, 1.0), 0.0)))
        del self.pairs[:-MEMORY]

    def direction(self, gradient: np.ndarray) -> np.ndarray:
        q, kept = gradient.copy(), []
        scale = np.zeros(gradient.shape[1])
        for moved, turned, rho in reversed(self.pairs):
            alpha = rho * (moved * q).sum(axis=0)
            q -= alpha * turned
            kept.append(alpha)
            squared = (turned * turned).sum(axis=0)
            fresh = (scale == 0) & (rho > 0)
            scale[fresh] = 1.0 / (rho[fresh] * squared[fresh])
        size = np.maximum(np.sqrt((gradient * gradient).sum(axis=0)), 1e-300)
        q *= np.where(scale > 0, scale, np.minimum(1.0, 1.0 / size))
        for (moved, turned, rho), alpha in zip(self.pairs, reversed(kept)):
            q += moved * (alpha - rho * (turned * q).sum(axis=0))
        return -q


def fit_machines(
    points: DataFrame, waves: Waves, sizes: np.ndarray, classes: int, max_iter: int = 100, tol: float = 1e-6
) -> np.ndarray:
    """Weights (features + 1) x folds x classes of the machines that leave each fold out.

    ``points`` has the features, ``label`` and ``fold`` as numbers from 0; ``sizes`` are the rows per fold. The
    penalty is worth one row of loss; the constant has none. A machine is done when a step lowers its
    objective by less than ``tol`` of it; ``max_iter`` bounds the passes.
    """
    folds = len(sizes)
    rows = np.repeat(np.maximum(sizes.sum() - sizes, 1), classes).astype(float)
    shape = (len(waves.shifts) + 1, folds * classes)
    counted = np.ones((shape[0], 1))
    counted[-1] = 0.0  # the constant

    weights, step = np.zeros(shape), np.zeros(shape)
    losses, gradient = _sums(points, waves, weights, step, folds, classes)
    value, gradient = losses[0] / rows, gradient / rows
    search, live = Search(), np.ones(shape[1], bool)
    step, again = search.direction(gradient), np.zeros(shape[1], bool)
    for _ in range(max_iter):
        losses, there = _sums(points, waves, weights, step, folds, classes)
        trials = np.stack([weights + t * step for t in STEPS])
        values = losses / rows + 0.5 / rows * (trials * trials * counted).sum(axis=1)
        there = there / rows + (weights + step) * counted / rows
        slope = (gradient * step).sum(axis=0)
        good = live & (values[0] < value) & (again | (values[0] <= value + 1e-4 * slope))
        best = values.argmin(axis=0)
        shorter = live & ~good & (values.min(axis=0) < value)
        moved = np.where(good, step, 0.0)
        search.remember(moved, np.where(good, there - gradient, 0.0))
        gain = np.where(good, value - values[0], np.inf)
        weights, gradient = weights + moved, np.where(good, there, gradient)
        value = np.where(good, values[0], value)
        live &= (good & (gain > tol * np.maximum(np.abs(value), 1e-12))) | shorter
        if not live.any():
            break
        step = np.where(shorter, step * STEPS[best], search.direction(gradient)) * live
        again = shorter
    return weights.reshape(shape[0], folds, classes)


def cross_validated(df: DataFrame, count: int, max_iter: int, tol: float, seed: int = 0) -> DataFrame:
    """``df`` (features, ``prediction``, ``fold``) with the class ``guess`` of the machines that did not see the row's fold.

    Rows with a NULL, NaN or infinite feature, without a class or a fold are left out.
    """
    spark = df.sparkSession
    df = df.filter(usable(FEATURES) & F.col("prediction").isNotNull() & F.col("fold").isNotNull())
    points = df.select(*[F.col(f).cast("double").alias(f) for f in FEATURES], "prediction", "fold")
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        met = points.groupBy("prediction", "fold").count().collect()  # classes x folds rows
        labels, folds = sorted({r["prediction"] for r in met}), sorted({r["fold"] for r in met})
        if not labels:
            return df.withColumn("guess", F.col("prediction"))
        sizes = np.array([sum(r["count"] for r in met if r["fold"] == f) for f in folds])
        place = lambda c, values: F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)).cast("int") - 1
        numbered = points.select(*FEATURES, place("prediction", labels).alias("label"), place("fold", folds).alias("fold"))
        waves = fit_waves(points, count, seed)
        weights = fit_machines(numbered, waves, sizes, len(labels), max_iter, tol)
    finally:
        points.unpersist()
    sent = spark.sparkContext.broadcast((waves.directions, waves.shifts, weights, np.array(labels)))

    @F.arrow_udf(df.schema["prediction"].dataType)
    def guess(*columns: pa.Array) -> pa.Array:
        directions, shifts, w, known = sent.value
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns[:-1]])
        fold = columns[-1].to_numpy(zero_copy_only=False)
        z, best = Waves(directions, shifts)(x), np.zeros(len(x), int)
        for f in np.unique(fold):
            mine = fold == f
            best[mine] = (z[mine] @ w[:, f, :]).argmax(axis=1)
        return pa.array(known[best])

    return df.withColumn("guess", guess(*[F.col(f).cast("double") for f in FEATURES], place("fold", folds)))
