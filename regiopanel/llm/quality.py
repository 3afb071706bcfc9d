"""Quality scores: supervised subword embeddings.

A text is the mean of learned vectors of its hashed words and character n-grams
(3 to 5 bytes within a word and its borders), plus one vector for each place
where a word repeats the word before it; a softmax layer maps the mean to
the two labels.  Both are learned by numpy stochastic gradient descent over a
bounded labelled sample (``bound`` ids, see ``training_sample``).  As the mean and
the output layer are linear, scoring needs only each slot's difference of the two
logits, one float for each slot, which is broadcast.  Every whole text is scored.

Defined cases: null and empty texts have no feature and get the score of the
bias; without training rows every score is 0.5; null ids count as held out (the
empty id text has remainder 0); repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_name, id_text, long_id, mix64, word_hashes
from .labelled import id_bucket, training_sample


_SAME = mix64(np.full(1, 1, np.uint64))[0]  # the feature "same word again"


def features(text: str, bits: int, sizes=(3, 4, 5)) -> np.ndarray:
    """Slots of a text's words and character n-grams, with repeats; case and
    punctuation are kept, as both tell about quality."""
    words = text.encode().split()
    if not words:
        return np.empty(0, np.int64)
    shift = np.uint64(64 - bits)
    h = mix64(word_hashes(words))
    same = np.full(int((h[1:] == h[:-1]).sum()), _SAME, np.uint64)
    slots = [h >> shift, same >> shift]
    flat = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    gap = flat == 32
    code = flat.astype(np.uint64) + np.uint64(1)
    for n in sizes:
        m = len(flat) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + code[i:i + m]
        inside = ~gap[1:m + 1]
        for i in range(2, n - 1):
            inside &= ~gap[i:i + m]
        slots.append(mix64(h[inside]) >> shift)
    return np.concatenate(slots).astype(np.int64)


def train(sample: DataFrame, bits: int, dim: int, epochs: int, rate: float) -> tuple[np.ndarray, float]:
    """(logit difference of each slot, bias difference).  The sample is bounded,
    so one task learns from it."""

    def fit(batches):
        rows = []
        for b in batches:
            for o, y, t in zip(b["ord"], b["label"], b["text"]):
                slots, n = np.unique(features(t, bits), return_counts=True)
                rows.append((o, y, slots, (n / max(1, n.sum())).astype(np.float32)))
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
        rng = np.random.default_rng(7)
        vec = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
        out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
        seen = np.zeros(1 << bits, bool)
        total, step = epochs * len(rows), 0
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                _, y, slots, share = rows[k]
                lr, step = rate * (1 - step / total), step + 1
                mean = share @ vec[slots]
                logit = out @ mean + bias
                p = np.exp(logit - logit.max())
                g = p / p.sum()
                g[y] -= 1
                back = out.T @ g
                out -= lr * np.outer(g, mean)
                bias -= 0.1 * lr * g
                vec[slots] -= np.outer(lr * share, back)
                seen[slots] = True
        if not rows:
            return
        diff = vec @ (out[1] - out[0])
        diff[~seen] = 0  # never trained: no evidence either way
        yield pd.DataFrame({"slot": [-1, *np.flatnonzero(seen)], "diff": [float(bias[1] - bias[0]), *diff[seen].astype(float)]})

    slots, bias = np.zeros(1 << bits, np.float32), 0.0
    for part in sample.repartition(1).mapInPandas(fit, "slot long, diff double").toArrow().to_batches():
        at, diff = (c.to_numpy() for c in part.columns)
        slots[at[at >= 0]] = diff[at >= 0]
        bias += diff[at < 0].sum()
    return slots, bias


def _score_columns(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, folds: int,
                   bound: int, bits: int, dim: int, epochs: int, rate: float):
    """A function from a pandas series of texts to their scores."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(
        train(training_sample(docs, labels, label, folds, bound, id_col, text_col), bits, dim, epochs, rate))

    def scores(texts) -> np.ndarray:
        diff, bias = model.value
        logit = np.full(len(texts), bias)
        for i, t in enumerate(texts):
            slots = features(t, bits) if t else ()
            if len(slots):
                logit[i] += diff[slots].mean(dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))

    return scores


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
                   text_col: str = "text", folds: int = 5, bound: int = 8000, bits: int = 18, dim: int = 10,
                   epochs: int = 6, rate: float = 2.0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    scores = _score_columns(docs, labels, label, id_col, text_col, folds, bound, bits, dim, epochs, rate)

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": scores(b["text"])})

    scored = long_id(docs.select(id_text(id_col), F.col(text_col).alias("text")) \
        .mapInPandas(run, "doc_id string, score double"))
    return scored.select("doc_id", (id_bucket("doc_id", folds) == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
              text_col: str = "text", folds: int = 5, bound: int = 8000, bits: int = 18, dim: int = 10,
              epochs: int = 6, rate: float = 2.0, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, all columns
    unchanged; the text passes through the scorer next to them."""
    score = fresh_name(docs, "score_")
    scores = _score_columns(docs, labels, label, id_col, text_col, folds, bound, bits, dim, epochs, rate)
    scored = F.pandas_udf(lambda s: pd.Series(scores(s)), "double")
    return docs.withColumn(score, scored(F.col(text_col))).where(F.col(score) >= threshold).drop(score)
