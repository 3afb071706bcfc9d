"""Toxicity scores: FTRL-proximal logistic regression on hashed word n-grams
and skip-grams.

Features of a text (lower-cased, ASCII punctuation split off): the set of hashed
words, bigrams, and pairs with one or two words between, in ``2**bits`` slots.
Training runs once over a bounded labelled sample (``bound`` ids, see
``training_sample``), each pass in an order fixed by the id hash; per-coordinate
rates and the L1 term leave few non-zero weights, which are broadcast.  Scoring
reads every whole text.

Defined cases: null and empty texts have no feature and get the intercept's
score; without training rows every score is 0.5; null ids count as held out (the
empty id text has remainder 0); repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, id_text, long_id, mix64, word_hashes
from .labelled import id_bucket, training_sample

_SPLIT = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~",
                         b"abcdefghijklmnopqrstuvwxyz" + b" " * 32)


def features(text: str, bits: int) -> np.ndarray:
    """Distinct slots of a text's words, bigrams and skip-grams."""
    h = word_hashes(text.encode().translate(_SPLIT).split())
    grams = [h]
    for gap in (1, 2, 3):
        if len(h) > gap:
            grams.append(mix64(h[:-gap] * np.uint64(0x9E3779B97F4A7C15 + 2 * gap) + h[gap:]))
    return np.unique(np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """FTRL-proximal state; slot ``2**bits`` is the intercept, without L1."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)

    def weights(self, slots) -> np.ndarray:
        z = self.z[slots]
        l1 = np.where(np.asarray(slots) == len(self.z) - 1, 0.0, self.l1)
        rate = (self.beta + np.sqrt(self.n[slots])) / self.alpha + self.l2
        return np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / rate, 0.0)

    def learn(self, slots: np.ndarray, label: int) -> None:
        slots = np.append(slots, len(self.z) - 1)
        w = self.weights(slots)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = n + g * g


def train(sample: DataFrame, bits: int, passes: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights, intercept last.  The sample is bounded, so one task learns from it
    and only non-zero weights come back."""

    def fit(batches):
        rows = [(o, y, features(t, bits)) for b in batches for o, y, t in zip(b["ord"], b["label"], b["text"])]
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
        model = Ftrl(bits, alpha, beta, l1, l2)
        for _ in range(passes):
            for _, y, slots in rows:
                model.learn(slots, y)
        w = model.weights(np.arange(len(model.z)))
        at = np.flatnonzero(w)
        yield pd.DataFrame({"slot": at, "weight": w[at]})

    out = np.zeros((1 << bits) + 1)
    for slot, weight in sample.repartition(1).mapInPandas(fit, "slot long, weight double").collect():
        out[slot] = weight
    return out


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id",
                    text_col: str = "text", folds: int = 5, bound: int = 12000, bits: int = 20, passes: int = 3,
                    alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.1,
                    threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sample = training_sample(docs, labels, label, folds, bound, id_col, text_col)
    model = spark.sparkContext.broadcast(train(sample, bits, passes, alpha, beta, l1, l2).astype(np.float32))

    def score(batches):
        w = model.value
        for b in batches:
            logit = np.array([w[features(t, bits)].sum(dtype=np.float64) + w[-1] for t in b["text"]])
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": 1 / (1 + np.exp(-np.clip(logit, -500, 500)))})

    scored = long_id(docs.select(id_text(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .mapInPandas(score, "doc_id string, score double"))
    return scored.select("doc_id", (id_bucket("doc_id", folds) == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
