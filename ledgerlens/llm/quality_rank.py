"""Quality score by Bradley-Terry pairwise ranking.

Method: every labelled pair (good text, bad text) is a preference; the chance
that i beats j is the logistic function of u(i) - u(j), with u linear in the
features. Weights minimise the logistic loss of feature differences over
preference pairs, and the threshold is a quantile of the scores: the one that
leaves as large a share above it as is labelled good. The score maps u to
(0, 1) by a logistic curve that passes ``cut`` at that threshold.

Features: hashed n-gram frequencies and a few shape figures of the whole text
(``features``); label, language, source and id are never among them. All
labelled rows outside the held-out fold are used: three quarters fit the
weights, one quarter sets quantile and slope. Rows of the larger class are in
``PARTNERS`` pairs each, those of the other take turns.

At scale: features are made once and kept on the executors' disks in parts of about ``PART`` rows,
dealt by a hash of the id; a row's partners are in its part. One job a gradient
step adds up the pairs of all parts, and all rows move one set of weights. A
task holds one part at a time; the driver holds the weights and, from each of at
most ``linear.TASKS`` tasks, one gradient. Slope and quantile come from sums and an exact
percentile over the scores of the whole quarter.

Defined results: null text scores as empty text; without usable labels of both
classes every score is 0.5. One row per input row; a null id counts as empty
text in ``held_out``.
An empty table of documents gives an empty result,
one of labels the score 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession

from .features import N_DENSE, WIDTH, dense, linear_scores, text_stats
from .frames import fold, map_texts
from .kernels import Block
from .linear import AT_LEAST, HELD, Part, Sample, descend, held_rows, held_scores, labelled_parts, met_in, platt, platt_of, sigmoid, summed

PART = 3000  # labelled rows of a part, about
PARTNERS = 8  # preference pairs of each row of the larger class
CUT = 0.3
FOLDS = 5


@dataclass
class RankModel:
    weights: np.ndarray
    shape: np.ndarray
    slope: float
    offset: float

    def scores(self, block: Block) -> np.ndarray:
        u = linear_scores(block, self.weights) + dense(text_stats(block)) @ self.shape
        return sigmoid(self.slope * u + self.offset)


NONE = RankModel(np.zeros(WIDTH), np.zeros(N_DENSE), 0.0, 0.0)  # scores 0.5


def preferences(label: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (good, bad) of each preference pair."""
    good, bad = np.flatnonzero((label == 1) & ~held), np.flatnonzero((label == 0) & ~held)
    if not len(good) or not len(bad):
        return good[:0], bad[:0]
    k = np.arange(PARTNERS * max(len(good), len(bad)))
    return good[k % len(good)], bad[(k + k // len(good) * 7) % len(bad)]


def utilities(s: Sample, w: np.ndarray) -> np.ndarray:
    return s.scores(w[:WIDTH]) + s.dense @ w[WIDTH:]


def pair_gradient(s: Sample, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient of the pairs' added logistic losses."""
    u = utilities(s, w)
    push = sigmoid(u[i] - u[j]) - 1
    by_row = np.bincount(i, push, len(u)) - np.bincount(j, push, len(u))
    return np.concatenate((s.gradient(by_row), s.dense.T @ by_row))


def _model(w: np.ndarray, slope: float, threshold: float, cut: float) -> RankModel:
    return RankModel(w[:WIDTH].astype(np.float32), w[WIDTH:], slope, float(np.log(cut / (1 - cut)) - slope * threshold))


def fit_pairs(s: Sample, steps: int = 60, ridge: float = 1e-5, cut: float = CUT) -> RankModel:
    """The model of rows that are in memory."""
    held = held_rows(len(s.label))
    i, j = preferences(s.label, held)
    if not len(i) or len(np.unique(s.label[held])) < 2:
        return NONE
    w = descend(lambda w: pair_gradient(s, i, j, w) / len(i) + ridge * w, WIDTH + N_DENSE, steps)
    u = utilities(s, w)[held]
    slope, _ = platt(u, s.label[held])
    if slope <= 0:
        return NONE
    return _model(w, slope, np.quantile(u, 1 - s.label[held].mean()), cut)


def fit_parts(spark: SparkSession, parts: RDD, steps: int = 60, ridge: float = 1e-5, cut: float = CUT) -> RankModel:
    """The model of all rows of ``linear.labelled_parts``, by the same steps as ``fit_pairs``."""

    def pairs(part: Part) -> tuple[np.ndarray, np.ndarray]:
        return preferences(part.label, part.role == HELD)

    def counts(part: Part) -> np.ndarray:
        held = part.label[part.role == HELD]
        return np.concatenate((met_in(part), [len(pairs(part)[0]), held.sum(), len(held) - held.sum()]))

    found = summed(parts, counts)
    used, (n, good, bad) = np.append(found[:WIDTH] >= AT_LEAST, np.ones(N_DENSE, bool)), found[WIDTH:]
    if not n or not good or not bad:
        return NONE

    def grad(w: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(w)
        total = summed(parts, lambda part: pair_gradient(part, *pairs(part), shared.value))
        shared.destroy()
        return total * used / n + ridge * w

    w = descend(grad, WIDTH + N_DENSE, steps)
    shared = spark.sparkContext.broadcast(w)
    slope, threshold = platt_of(held_scores(spark, parts, lambda part: utilities(part, shared.value)))
    shared.destroy()
    return _model(w, slope, threshold, cut) if slope > 0 else NONE


def fit(docs: DataFrame, labels: DataFrame, rows: int = PART) -> RankModel:
    """Learns from all labelled rows outside the held-out fold, and from no others; ``rows``: of a part."""
    parts = labelled_parts(docs, labels, "quality", rows, fold("doc_id", FOLDS) != 0)
    if parts is None:
        return NONE
    try:
        return fit_parts(docs.sparkSession, parts)
    finally:
        parts.unpersist()


def quality_scores(docs: DataFrame, model: RankModel, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(block: Block) -> dict[str, np.ndarray]:
        p = shared.value.scores(block)
        return {"score": p, "predicted": (p >= cut).astype(np.int32)}

    rows = docs.select("doc_id", "text", (fold("doc_id", FOLDS) == 0).alias("held_out"))
    return map_texts(rows, ["doc_id", "held_out"], score, "doc_id long, held_out boolean, score double, predicted int")
