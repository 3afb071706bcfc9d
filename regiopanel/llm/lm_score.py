"""Language-model scores: a causal self-attention model on subword ids.

Text.  Lower-cased words (A-Z only), each as the ids of a blank and the word in a
public byte-level vocabulary, then one end token.  Words never share a subword, so
a word's ids are computed once per task and looked up after that.

Corpus statistics.  Words, and through them subwords, are counted over all
training documents (crc32 of the id modulo ``folds`` is not 0), and so are the ids that
follow each other: for each of the ``rows`` most frequent ids, and for all others as
one, what comes right before it and 2, 4 and 8 places before.  The most frequent
subwords are output classes of their own; the others share classes by the company
they keep in these counts, and a token's probability is that of its class times its
share of the class's count in the whole corpus.  The base score uses the word counts.

Model.  One causal attention head over learned embeddings and positions with a
residual to the class layer, whose logits start from the corpus-wide counts of the class
behind each id (a fixed table).  All else is learned by numpy gradient descent (Adam)
from every id of every training document, beginning with that table alone, in windows that hold each id once.  Each of
``rounds`` rounds takes its share of the documents: every task goes on from the common
parameters with its own documents, and the tasks' parameters are averaged by their
numbers of windows, in a tree.  Parameters have a fixed size and are broadcast.  For
trials on a part of the text, ``sample_docs`` documents can be learned first in one task,
and ``every`` takes one window for that many words; the query uses neither.

Scoring.  Windows of ``context + stride`` ids step by ``stride``; each window
scores its last ``stride`` ids, with the ids before as context, so every token is
scored once, in batches of masked attention.

Word counts are exact for any vocabulary: the ``frequent`` most frequent words are
broadcast, all rarer ones of a document are looked up by a shuffled join.

Defined cases: null, empty and blank texts are the end token alone; a null id
counts as held out; rows that repeat are scored each; with an empty training
corpus every count is 0 and the model stays as it was drawn.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, bounded_batches, drop_stage, id_text, kept_in_worker, stage, tree_sum
from .labelled import id_bucket
from .packing import byte_encoding

END_WORD = b""  # no word is empty
VOCABULARY = 50257  # ids of the public vocabulary; the end token is the next one
END = VOCABULARY
PACKED = np.dtype("<u2")  # holds every id


class WordIds(dict):
    """Subword ids of words, two bytes each, remembered for the words met so far."""

    def __init__(self, remember: int = 300_000):
        super().__init__({END_WORD: np.array([END], PACKED).tobytes()})
        self.encode = kept_in_worker("byte_bpe_50k", byte_encoding).encode_ordinary
        self.remember = remember

    def __missing__(self, word: bytes) -> bytes:
        ids = np.array(self.encode(" " + word.decode()), PACKED).tobytes()
        if len(self) < self.remember:
            self[word] = ids
        return ids

    def __call__(self, word: bytes) -> list[int]:
        return np.frombuffer(self[word], PACKED).tolist()

    def packed(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.__getitem__, words))


# --- corpus counts ---------------------------------------------------------

def word_counts(texts: DataFrame, flush: int = 200_000) -> DataFrame:
    """(word, c) over all rows; tasks add up their words before the shuffle."""

    def run(batches):
        counts = Counter()
        for b in batches:
            for t in b["text"]:
                counts.update(ascii_words(t))
            counts[END_WORD] += len(b)
            if len(counts) >= flush:
                yield pd.DataFrame({"word": counts.keys(), "n": counts.values()})
                counts = Counter()
        if counts:
            yield pd.DataFrame({"word": counts.keys(), "n": counts.values()})

    parts = texts.select("text").mapInPandas(run, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("c"))


def frequent_words(counts: DataFrame, most: int) -> tuple[dict, int]:
    """Words counted at least ``least`` times, and ``least``: the smallest power of
    two for which at most ``most`` words remain."""
    by_size = sorted(counts.groupBy(F.floor(F.log2("c")).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    total, k = 0, 62
    for r in by_size:
        total += r.n
        if total > most:
            break
        k = r.k
    least = 1 << int(k)
    return {bytes(r.word): r.c for r in counts.where(F.col("c") >= least).collect()}, least


def subword_counts(counts: DataFrame) -> np.ndarray:
    """Counts of the subwords of all words; at most one row per id is collected."""

    def run(batches):
        ids, total = WordIds(remember=0), np.zeros(VOCABULARY + 1, np.int64)
        for b in batches:
            for w, c in zip(b["word"], b["c"]):
                for i in ids(bytes(w)):
                    total[i] += c
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    out = np.zeros(VOCABULARY + 1, np.int64)
    for r in counts.mapInPandas(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def pair_counts(texts: DataFrame, row_of: np.ndarray, rows: int, slot_of: np.ndarray, slots: int, near: int) -> np.ndarray:
    """Counts over all texts, (rows + 1) x (slots + near): how often each row's ids come
    right behind a slot, and 2, 4 or 8 places behind one of the first ``near`` slots.
    Tasks add up their counts, Spark adds up the tasks'; ``rows`` + 1 rows are collected."""

    def run(batches):
        right, apart = np.zeros((rows + 1) * slots, np.int64), np.zeros((rows + 1) * near, np.int64)
        for b in batches:
            ids, starts, ends = joined_ids(b["ids"])
            if not len(ids):
                continue
            row, slot = row_of[ids], slot_of[ids]
            place = np.arange(len(ids)) - np.repeat(starts, ends - starts)
            right += np.bincount(row * slots + inputs_of(ids, starts, slot_of), minlength=len(right))
            for d in (2, 4, 8):
                ok = (place[d:] >= d) & (slot[:-d] < near)
                apart += np.bincount(row[d:][ok] * near + slot[:-d][ok], minlength=len(apart))
        both = np.hstack([right.reshape(rows + 1, slots), apart.reshape(rows + 1, near)])
        some = np.flatnonzero(both.any(1))
        yield pd.DataFrame({"row": some, "counts": [zlib.compress(both[i].tobytes(), 1) for i in some]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in frame["counts"])
        return pd.DataFrame({"row": [frame["row"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    out = np.zeros((rows + 1, slots + near), np.int64)
    sums = encoded(texts).select("ids").mapInPandas(run, "row long, counts binary").groupBy("row").applyInPandas(add, "row long, counts binary")
    for r in sums.collect():
        out[r.row] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.int64)
    return out


def token_classes(order: np.ndarray, counts: np.ndarray, right: np.ndarray, apart: np.ndarray, own: int, shared: int,
                  dims: int = 24, iterations: int = 12) -> np.ndarray:
    """Class of each id.  The ``own`` most frequent ids (``order``) are classes of their
    own; the next ones, as far as the rows of ``right`` and ``apart`` go, are grouped by
    the company they keep, by weighted k-means on a few principal directions; the last
    class takes all others."""
    of = np.full(len(counts), own + shared - 1, np.int64)
    of[order[:own]] = np.arange(own)
    use = order[:len(right)][counts[order[:len(right)]] > 0]
    if len(use) <= own + shared or not right.any():
        return of
    m = np.hstack([right[:len(use)], apart[:len(use)]]).astype(np.float64)
    total, usual = m.sum(1, keepdims=True), m.sum(0) / m.sum()
    x = np.sqrt((m + 50 * usual) / (total + 50)) - np.sqrt(usual)  # few sightings: close to the usual
    mass = counts[use].astype(np.float64)
    z = x @ np.linalg.svd(x.T @ (x * mass[:, None]))[0][:, :dims]
    z, mass, k = z[own:], mass[own:], shared - 1
    centre = z[np.random.default_rng(0).choice(len(z), k, replace=False, p=mass / mass.sum())]
    for _ in range(iterations):
        nearest = ((centre ** 2).sum(1) - 2 * z @ centre.T).argmin(1)
        for j in np.unique(nearest):
            mine = nearest == j
            centre[j] = (z[mine] * mass[mine, None]).sum(0) / mass[mine].sum()
    of[use[own:]] = own + nearest
    return of


def following_table(order: np.ndarray, right: np.ndarray, class_of: np.ndarray, classes: int, prior: float = 20.0) -> np.ndarray:
    """ln of each class's share behind each slot, slots x classes, from counts over the
    whole corpus; rarely seen slots stay close to the classes' own shares."""
    of_row = np.append(class_of[order[:len(right) - 1]], classes - 1)
    seen = np.zeros((classes, right.shape[1]))
    np.add.at(seen, of_row, right)
    share = (seen.sum(1) + 0.1) / (seen.sum() + 0.1 * classes)
    return np.log((seen.T + prior * share) / (seen.sum(0)[:, None] + prior)).astype(np.float32)


# --- the model -------------------------------------------------------------

class Attention:
    """One causal head: parameters, training and scoring."""

    def __init__(self, slots: int, classes: int, dim: int, context: int, stride: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        width = context + stride
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.context, self.stride, self.dim = context, stride, dim
        self.p = {"E": draw(slots, dim), "P": draw(width, dim), "q": draw(dim, dim), "k": draw(dim, dim), "v": draw(dim, dim),
                  "o": draw(dim, dim), "c": draw(dim, classes), "b": np.zeros(classes, np.float32)}
        self.base = np.zeros((slots, classes), np.float32)  # fixed logits behind each slot
        self.causal = np.where(np.arange(width)[None, :] <= np.arange(width)[:, None], 0, -1e4).astype(np.float32)
        self.sees = np.exp(self.causal)  # 1 or 0

    def gradients(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray, block: int = 32):
        """Loss and gradients for windows of inputs ``x`` and classes ``y``; the valid
        places of a window come first.  Worked out for ``block`` windows at a time, which
        stay in the processor's cache."""
        n, base = max(1, int(valid.sum())), self.base + self.p["b"]
        loss, grad, at_inputs = 0.0, None, []
        for at in range(0, len(x), block):
            part, g, dh = self._part_gradients(x[at:at + block], y[at:at + block], valid[at:at + block], base, n)
            loss += part
            at_inputs.append(dh)
            if grad is None:
                grad = g
            else:
                for name in g:
                    grad[name] += g[name]
        slots, d = self.p["E"].shape
        at = (x.ravel()[:, None] * d + np.arange(d)).ravel()
        grad["E"] = np.bincount(at, np.concatenate(at_inputs).ravel(), slots * d).reshape(slots, d).astype(self.p["E"].dtype)
        return loss, grad

    def _part_gradients(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray, base: np.ndarray, n: int):
        """Loss, gradients but that of E, and the gradient at each place's input.  No valid
        place attends to one that is not, as those come last."""
        p, d, shape = self.p, self.dim, (*x.shape, self.dim)
        flat = lambda m: m.reshape(-1, m.shape[-1])
        norm = lambda m: float(np.sqrt(np.square(m).sum(-1).max()))
        scale = np.float32(1 / math.sqrt(d))
        h = p["E"][x] + p["P"]
        qkv = np.concatenate([p["q"] * scale, p["k"], p["v"]], 1)
        out = flat(h) @ qkv
        q, k = out[:, :d].reshape(shape), out[:, d:2 * d].reshape(shape)
        v = np.concatenate([out[:, 2 * d:], np.ones((len(out), 1), out.dtype)], 1).reshape(*x.shape, d + 1)
        w = np.matmul(q, k.transpose(0, 2, 1))  # weights before they are divided by their sum
        if norm(q) * norm(k) > 60:  # only then can exp overflow
            w += self.causal
            w -= w.max(-1, keepdims=True)
        np.exp(w, out=w)
        w *= self.sees
        z = np.matmul(w, v)
        total = z[:, :, d:]
        z = z[:, :, :d] / total
        u = h + (flat(z) @ p["o"]).reshape(shape)
        at = np.flatnonzero(valid)
        u_at, y_at, row = flat(u)[at], y.ravel()[at], np.arange(len(at))
        e = u_at @ p["c"]
        e += base[x.ravel()[at]]
        if norm(u_at) * norm(p["c"].T) + float(np.abs(base).max()) > 80:
            e -= e.max(-1, keepdims=True)
        target = e[row, y_at]
        np.exp(e, out=e)
        each = e.sum(-1)
        loss = float((np.log(each) - target).sum()) / n
        e *= (1 / (each * n))[:, None].astype(e.dtype)
        e[row, y_at] -= np.float32(1 / n) if e.dtype == np.float32 else 1 / n
        grad = {"c": u_at.T @ e, "b": e.sum(0)}
        du = np.zeros_like(flat(u))
        du[at] = e @ p["c"].T
        grad["o"] = flat(z).T @ du
        dz = (du @ p["o"].T).reshape(shape) / total
        dv = np.matmul(w.transpose(0, 2, 1), dz)
        ds = np.matmul(np.concatenate([dz, -(dz * z).sum(-1, keepdims=True)], -1), v.transpose(0, 2, 1))
        ds *= w
        d_qkv = np.concatenate([flat(np.matmul(ds, k)), flat(np.matmul(ds.transpose(0, 2, 1), q)), flat(dv)], 1)
        whole = flat(h).T @ d_qkv
        grad["q"], grad["k"], grad["v"] = whole[:, :d] * scale, whole[:, d:2 * d], whole[:, 2 * d:]
        dh = du + d_qkv @ qkv.T
        grad["P"] = dh.reshape(shape).sum(0)
        return loss, grad, dh

    def fit(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray, epochs: int, rate: float, batch: int = 128) -> None:
        rng = np.random.default_rng(2)
        m = {k: np.zeros_like(w) for k, w in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        steps, t = epochs * -(-len(x) // batch), 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows, t = order[at:at + batch], t + 1
                _, grad = self.gradients(x[rows], y[rows], valid[rows])
                lr = rate * (1 - 0.9 * t / steps)
                for k, g in grad.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= lr * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.99 ** t)) + 1e-8)

    def log_probs(self, x: np.ndarray, y: np.ndarray, starts: np.ndarray, ends: np.ndarray, batch: int = 128) -> np.ndarray:
        """ln of each class ``y`` given the inputs before; texts lie one after the
        other at [start, end)."""
        p, c, s, d = self.p, self.context, self.stride, self.dim
        counts = -(-(ends - starts) // s)
        doc = np.repeat(np.arange(len(starts)), counts)
        first = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = starts[doc] + first * s  # the first id that a window scores
        begin, end = starts[doc], ends[doc]
        causal = np.exp(self.causal[c:])
        # per input slot and per place: query; key; value through the output layer, and a 1
        # that sums the weights
        scale = np.float32(1 / math.sqrt(d))
        q, q_at = p["E"] @ p["q"] * scale, (p["P"] @ p["q"] * scale)[c:]
        k, k_at = p["E"] @ p["k"], p["P"] @ p["k"]
        vo = p["v"] @ p["o"]
        v = np.concatenate([p["E"] @ vo, np.ones((len(k), 1), np.float32)], 1)
        v_at = np.concatenate([p["P"] @ vo, np.zeros((len(k_at), 1), np.float32)], 1)
        norm = lambda m: float(np.sqrt(np.square(m).sum(-1)).max())
        hot = (norm(q) + norm(q_at)) * (norm(k) + norm(k_at)) > 60  # only then can exp overflow
        reach_u = norm(p["E"]) + norm(p["P"]) + norm(v[:, :d]) + norm(v_at[:, :d])
        hot_logit = reach_u * norm(p["c"].T) + float(np.abs(p["b"]).max()) > 80
        base = self.base + p["b"]
        out = np.zeros(len(x), np.float32)
        reach = np.arange(-c, s)
        for b in range(0, len(at), batch):
            where = at[b:b + batch, None] + reach
            inside = (where >= begin[b:b + batch, None]) & (where < end[b:b + batch, None])
            slots = x[np.where(inside, where, 0)]
            mine = slots[:, c:]
            w = np.matmul(q[mine] + q_at, (k[slots] + k_at).transpose(0, 2, 1))
            if hot:
                np.clip(w, -60, 60, out=w)
            np.exp(w, out=w)
            w *= causal
            values = v[slots]
            values += v_at
            if not inside.all():
                values *= inside[:, :, None]
            z = np.matmul(w, values)
            scored = inside[:, c:]
            z = z[scored]
            mine, place = mine[scored], where[:, c:][scored]
            u = z[:, :d] / z[:, d:]
            u += p["E"][mine]
            u += p["P"][c:][np.nonzero(scored)[1]]
            logit = u @ p["c"]
            logit += base[mine]
            if hot_logit:
                np.clip(logit, -80, 80, out=logit)
            top = logit[np.arange(len(place)), y[place]]
            out[place] = top - np.log(np.exp(logit, out=logit).sum(-1))
        return out


def inputs_of(ids: np.ndarray, starts: np.ndarray, slot_of: np.ndarray) -> np.ndarray:
    """Input slots: that of the id before; slot 0 at a text's start."""
    x = np.empty(len(ids), np.int64)
    x[1:] = slot_of[ids[:-1]]
    x[starts] = 0
    return x


def joined_ids(packed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed ids of texts in a row with the texts' starts and ends."""
    ends = np.cumsum([len(x) // PACKED.itemsize for x in packed], dtype=np.int64)
    return np.frombuffer(b"".join(packed), PACKED).astype(np.int64), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


def packed_ids(texts, ids_of: WordIds) -> list[bytes]:
    return [ids_of.packed([*ascii_words(t), END_WORD]) for t in texts]


def text_ids(texts, ids_of: WordIds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts in a row with their starts and ends."""
    return joined_ids(packed_ids(texts, ids_of))


def encoded(texts: DataFrame) -> DataFrame:
    """(doc_id, ids): the packed ids of each whole text; as it is if it has ids already."""
    if "ids" in texts.columns:
        return texts

    def run(batches):
        ids_of = WordIds()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": packed_ids(b["text"], ids_of)})

    return texts.select("doc_id", "text").mapInPandas(run, "doc_id string, ids binary")


def windows(starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, valid) of windows that hold every id of the texts [start, end) once."""
    counts = -(-(ends - starts) // width)
    text = np.repeat(np.arange(len(starts)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    where = (starts[text] + nth * width)[:, None] + np.arange(width)
    valid = where < ends[text][:, None]
    return np.where(valid, where, 0), valid


def word_windows(texts, ids_of: WordIds, width: int, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, id before or -1, valid) of one window in each stretch of ``every`` words of a
    text, at a place that goes by the text's length; only the words there are encoded."""
    ids, before, lengths = [], [], []
    for t in texts:
        words = ascii_words(t)
        words.append(END_WORD)
        for nth, low in enumerate(range(0, len(words), every)):
            room = max(0, min(len(words), low + every) - low - width) + 1
            at = low + (len(words) + nth) * 7919 % room
            found = [i for w in words[at:at + width] for i in ids_of(w)][:width]
            before.append(ids_of(words[at - 1])[-1] if at else -1)
            lengths.append(len(found))
            ids.append(found + [END] * (width - len(found)))
    valid = np.arange(width)[None, :] < np.array(lengths, np.int64).reshape(-1, 1)
    return np.array(ids, np.int64).reshape(-1, width), np.array(before, np.int64), valid


def train(sample: DataFrame, make, slot_of: np.ndarray, class_of: np.ndarray, epochs: int, rate: float) -> dict:
    """Parameters learned in one task, as the sample is bounded; ``make`` gives the model."""

    def fit(batches):
        rows = sorted((o, t) for b in batches for o, t in zip(b["ord"], b["text"]))
        model = make()
        ids, starts, ends = text_ids([t for _, t in rows], WordIds())
        if len(ids):
            where, valid = windows(starts, ends, model.context + model.stride)
            model.fit(inputs_of(ids, starts, slot_of)[where], class_of[ids][where], valid, epochs, rate)
        yield pd.DataFrame({"model": [pickle.dumps(model.p)]})

    learned = sample.repartition(1).mapInPandas(fit, "model binary").first()
    return make().p if learned is None else pickle.loads(learned.model)  # None: no training document


def by_size(texts, most: int = 4_000_000):
    """``texts``, or their packed ids, in lists of about ``most`` characters or bytes, so that
    windows of long ones fit."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def whole_windows(packed, slot_of: np.ndarray, class_of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(input slots, classes, valid) of windows that hold every id of the packed texts once."""
    ids, starts, ends = joined_ids(packed)
    where, valid = windows(starts, ends, width)
    return inputs_of(ids, starts, slot_of)[where], class_of[ids][where], valid


def training_windows(texts, ids_of: WordIds, slot_of: np.ndarray, class_of: np.ndarray, width: int,
                     every: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(input slots, classes, valid) of the windows learned from: those that hold every id
    once, or one for ``every`` words."""
    if every is None:
        return whole_windows(packed_ids(texts, ids_of), slot_of, class_of, width)
    ids, before, valid = word_windows(texts, ids_of, width, every)
    first = np.where(before < 0, 0, slot_of[before])[:, None]
    return np.hstack([first, slot_of[ids[:, :-1]]]), class_of[ids], valid


def refine(learn: DataFrame, make, parameters: dict, slot_of: np.ndarray, class_of: np.ndarray, rounds: int, every: int | None,
           rates: list[float]) -> dict:
    """The parameters after ``rounds`` rounds over all training documents, given by their
    texts or, without ``every``, by their packed ids."""
    what = "ids" if "ids" in learn.columns else "text"
    names, tasks = sorted(parameters), learn.rdd.getNumPartitions()
    flat = lambda p: np.concatenate([p[k].ravel() for k in names]).astype(np.float64)
    for turn in range(rounds):
        start = learn.sparkSession.sparkContext.broadcast(parameters)

        def run(batches, start=start, rate=rates[turn]):
            from pyspark import TaskContext

            model, ids_of, n = make(), WordIds(), 0
            model.p = {k: w.copy() for k, w in start.value.items()}
            for b in batches:
                for part in by_size(b[what]):
                    width = model.context + model.stride
                    x, y, valid = whole_windows(part, slot_of, class_of, width) if what == "ids" \
                        else training_windows(part, ids_of, slot_of, class_of, width, every)
                    model.fit(x, y, valid, 1, rate, max(8, min(128, len(x) // 120)))  # a small part in small steps
                    n += len(x)
            if n:
                data = np.append(flat(model.p) * n, n).tobytes()
                yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "data": [data]})

        mine = learn.where(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds)) == turn).select(what)
        total = tree_sum(mine.mapInPandas(run, "part long, data binary"), tasks)
        start.unpersist()
        if total is not None:
            mean, at, parameters = total[:-1] / total[-1], 0, dict(parameters)
            for k in names:
                size = parameters[k].size
                parameters[k] = mean[at:at + size].reshape(parameters[k].shape).astype(np.float32)
                at += size
    return parameters


# --- the operator ----------------------------------------------------------

def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, frequent: int = 200_000,
              sample_docs: int = 0, own: int = 64, shared: int = 96, slots: int = 1024, dim: int = 24,
              context: int = 16, stride: int = 48, epochs: int = 2, rate: float = 0.02, rows: int = 3000, near: int = 258,
              rounds: int = 3, every: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for
    every row of ``docs``; scores are log10 probabilities of whole texts."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(id_text(id_col), F.col(text_col).alias("text"))
    learn = texts.where(id_bucket("doc_id", folds) != 0)
    counts = stage(word_counts(learn), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    common, least = frequent_words(counts, frequent)
    subwords = subword_counts(counts)
    order = np.argsort(-subwords, kind="stable")
    slot_of = np.full(VOCABULARY + 1, 1, np.int64)  # 0: start of a text, 1: rare ids
    slot_of[order[:slots - 2]] = np.arange(2, slots)
    row_of = np.full(VOCABULARY + 1, rows, np.int64)
    row_of[order[:rows]] = np.arange(rows)
    ids = stage(encoded(learn), "ids")  # counted and learned from: each text is encoded once for both
    pairs = pair_counts(ids, row_of, rows, slot_of, slots, near)
    right, apart = pairs[:, :slots], pairs[:, slots:]
    class_of = token_classes(order, subwords, right[:rows, :near], apart[:rows], own, shared)
    base = following_table(order, right, class_of, own + shared)

    def make() -> Attention:
        model = Attention(slots, own + shared, dim, context, stride)
        model.base = base
        return model

    parameters, rates = make().p, [rate / 2 ** turn for turn in range(rounds)]
    parameters["c"][:] = 0  # the model starts as the table of counts
    if sample_docs:
        chosen = learn.select("doc_id").distinct().withColumn("ord", F.xxhash64("doc_id")).orderBy("ord", "doc_id").limit(sample_docs)
        sample = learn.join(F.broadcast(chosen), "doc_id").select("ord", F.coalesce("text", F.lit("")).alias("text"))
        parameters, rates = train(sample, make, slot_of, class_of, epochs, rate), [rate / 4] * rounds
    parameters = refine(learn if every else ids, make, parameters, slot_of, class_of, rounds, every, rates)
    drop_stage(ids)
    mass = subwords + 0.1
    ln_share = np.log(mass / np.bincount(class_of, mass, own + shared)[class_of])
    log_total = math.log10(n + 0.1 * (v + 1))
    logs = {w: math.log10(c + 0.1) for w, c in common.items()}
    sent = spark.sparkContext.broadcast((logs, class_of, ln_share, slot_of, parameters, base))

    def score(batches):
        logs, class_of, ln_share, slot_of, parameters, base = sent.value
        model = Attention(slots, own + shared, dim, context, stride)
        model.p, model.base = parameters, base
        ids_of = WordIds(remember=600_000)
        for b in batches:
            rows, packed = [], []
            for t in b["text"]:
                words = ascii_words(t)
                words.append(END_WORD)
                packed.append(ids_of.packed(words))
                found, rare = list(map(logs.get, words)), {}
                if None in found:
                    rare = Counter(w for w, e in zip(words, found) if e is None)
                    found = [e for e in found if e is not None]
                rows.append((len(words), len(found), sum(found), list(rare.keys()), list(rare.values())))
            ids, starts, ends = joined_ids(packed)
            ln = model.log_probs(inputs_of(ids, starts, slot_of), class_of[ids], starts, ends) + ln_share[ids]
            out = pd.DataFrame(rows, columns=["n_tokens", "n_known", "base", "rare", "times"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out.assign(score=np.add.reduceat(ln, starts) / math.log(10))

    schema = "doc_id string, n_tokens long, n_known long, base double, rare array<binary>, times array<long>, score double"
    scored = stage(texts.mapInPandas(score, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    looked_up = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")) \
        .select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("n")) \
        .join(counts.where(F.col("c") < least), "word", "left")
    rare = looked_up.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("rare_base"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"))
    return scored.drop("rare", "times").join(rare, "row", "left").select(
        F.col("doc_id").cast("long").alias("doc_id"), (id_bucket("doc_id", folds) == 0).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * log_total).alias("base_score"), "score")
