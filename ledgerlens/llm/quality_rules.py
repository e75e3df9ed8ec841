"""Quality rules: base rules plus a calibrated logistic regression on n-grams.

Method: hashed word and character n-grams (words, word pairs, byte 3-grams;
``2 ** BITS`` buckets a family) feed a logistic regression fitted on
labelled quality rows; its probability is calibrated on rows that the fit has
not seen (Platt scaling), and documents are scored in Arrow batches against
fixed thresholds. The base rules use exact counts over the whole text.

The fit takes at most ``sample`` labelled rows (a hash of the id chooses them);
three quarters fit the weights, one quarter the calibration. Scoring reads
every document once and shuffles nothing.

Defined results: null and empty text: all counts 0, base_failed, not kept.
Without usable labels of both classes the model has no verdict: every text
that passes the base rules is kept. Repeated rows each give one row; null ids
stay null. Only ``doc_id`` and ``text`` are read.
An empty table of documents gives
an empty result, one of labels a model without a verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import WIDTH, linear_scores, text_stats
from .frames import map_texts
from .kernels import Block, blocks, give_back
from .linear import Sample, descend, held_rows, labelled_rows, platt, sample_of, sigmoid

SAMPLE = 3000  # labelled rows that the model is fitted on, at most
KEEP = 0.5  # probability of good quality from which a text is kept
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass
class QualityModel:
    weights: np.ndarray
    slope: float
    offset: float

    def probability(self, block: Block) -> np.ndarray:
        return sigmoid(self.slope * linear_scores(block, self.weights) + self.offset)


def fit_sample(s: Sample, steps: int = 60, ridge: float = 1e-5) -> QualityModel:
    """Rows of each class weigh the same in the fit; the calibration undoes that."""
    n = len(s.label)
    if not n or s.label.min() == s.label.max():
        return QualityModel(np.zeros(WIDTH), 0.0, 30.0)
    held = held_rows(n)
    weight = np.where(s.label == 1, 0.5 / max(s.label.sum(), 1), 0.5 / max((1 - s.label).sum(), 1)) * ~held

    def grad(w: np.ndarray) -> np.ndarray:
        r = weight * (sigmoid(s.scores(w[:-1]) + w[-1]) - s.label)
        return np.append(s.gradient(r) + ridge * w[:-1], r.sum())

    w = descend(grad, WIDTH + 1, steps)
    out = s.scores(w[:-1])
    slope, offset = platt(out[held], s.label[held])
    if slope <= 0:  # held-out rows do not bear the fit out: no verdict
        return QualityModel(np.zeros(WIDTH), 0.0, 30.0)
    return QualityModel(w[:-1].astype(np.float32), slope, offset)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    return fit_sample(sample_of(labelled_rows(docs, labels, "quality", sample)))


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def quality_rules(docs: DataFrame, model: QualityModel, threshold: float = KEEP) -> DataFrame:
    """Counts, base_failed, probability and kept for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(block: Block) -> dict[str, np.ndarray]:
        stats = text_stats(block)
        failed = base_failed(stats)
        p = shared.value.probability(block)
        return {c: stats[c] for c in COUNTS} | {"base_failed": failed, "probability": p, "kept": ~failed & (p >= threshold)}

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, probability double, kept boolean"
    return map_texts(docs, ["doc_id"], score, schema)


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = KEEP) -> DataFrame:
    """The rows of ``docs`` (all columns as they are) that the rules keep."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def passes(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        for first in range(0, len(texts), 500):
            for a, b, raws in blocks(texts.slice(first, 500).to_pylist()):
                block = Block(raws)
                out[first + a : first + b] = ~base_failed(text_stats(block)) & (shared.value.probability(block) >= threshold)
        give_back()
        return pa.array(out)

    return docs.where(passes(docs["text"]))
