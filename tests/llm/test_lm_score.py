"""Base score against counting, the model's gradients, normalisation, edges."""
import math
import zlib
from collections import Counter

import numpy as np

import __spark_entry__ as E
from regiopanel.llm import lm_score as L
from tests.llm.brute import words

SF = "/root/testdata/sf0.01"


def tokens(text):
    return words(text) + [None]


def expected(docs):
    learn = [t for d, t in docs if zlib.crc32(("" if d is None else str(d)).encode()) % 10]
    c = Counter(w for t in learn for w in tokens(t))
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
    return [(d, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, base(t)) for d, t in docs]


def compare(rows, docs):
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows)
    want = sorted((str(d), *x) for d, *x in expected(docs))
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and math.isclose(g[4], w[4], rel_tol=1e-9)
    assert all(r.score < 0 for r in rows)


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = E.queries()["op8_lm_score"](spark, SF).collect()
    compare(rows, docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    uniform = sum(r.n_tokens for r in held) * math.log10(1 / L.VOCABULARY) * 2.4
    assert sum(r.score for r in held) > 0.55 * uniform  # far better than even chances for each subword


def test_rare_words_and_edges(spark):
    docs = [(i, f"common words w{i % 50} Only{i} é{i}") for i in range(300)] + [(None, None), (900, ""), (900, " \t"), (901, "x" * 40_000)]
    df = spark.createDataFrame([(d, t, 0.5) for d, t in docs], "doc_id long, text string, score double")
    compare(L.lm_scores(df, frequent=8, sample_docs=50).collect(), docs)
    assert L.lm_scores(df.where("false")).count() == 0


def small_model():
    m = L.Attention(slots=12, classes=7, dim=5, context=3, stride=4)
    for w in m.p.values():
        w += np.random.default_rng(3).standard_normal(w.shape).astype(np.float32) * 0.3
    return m


def test_windows_score_each_token_once_as_plain_attention():
    m, rng = small_model(), np.random.default_rng(5)
    lengths = [1, 3, 4, 5, 8, 30]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    x, y = rng.integers(0, 12, ends[-1]), rng.integers(0, 7, ends[-1])
    got = m.log_probs(x, y, starts, ends, batch=3)
    p = {k: w.astype(np.float64) for k, w in m.p.items()}
    for a, b in zip(starts, ends):
        for t in range(a, b):
            window = a + (t - a) // m.stride * m.stride - m.context  # place 0 of the window that scores t
            seen = np.arange(max(a, window), t + 1)
            h = p["E"][x[seen]] + p["P"][seen - window]
            e = np.exp(h @ p["k"] @ (h[-1] @ p["q"]) / math.sqrt(m.dim))
            u = h[-1] + (e / e.sum()) @ h @ p["v"] @ p["o"]
            logit = u @ p["c"] + p["b"]
            assert math.isclose(got[t], logit[y[t]] - np.log(np.exp(logit).sum()), rel_tol=1e-4, abs_tol=1e-4)


def test_gradients():
    m, rng = small_model(), np.random.default_rng(6)
    m.p = {k: w.astype(np.float64) for k, w in m.p.items()}
    x, y = rng.integers(0, 12, (3, 7)), rng.integers(0, 7, (3, 7))
    valid = np.arange(7)[None, :] < np.array([7, 4, 1])[:, None]
    _, grad = m.gradients(x, y, valid)
    for name, w in m.p.items():
        for at in list(np.ndindex(w.shape))[::11]:
            old = w[at]
            w[at] = old + 1e-5
            up, _ = m.gradients(x, y, valid)
            w[at] = old - 1e-5
            down, _ = m.gradients(x, y, valid)
            w[at] = old
            assert math.isclose((up - down) / 2e-5, grad[name][at], rel_tol=1e-2, abs_tol=1e-4), name


def test_classes_share_all_mass():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, L.VOCABULARY + 1)
    order = np.argsort(-counts, kind="stable")
    right, apart = rng.integers(0, 9, (301, 40)), rng.integers(0, 9, (301, 20))
    of = L.token_classes(order, counts, right[:300, :20], apart[:300], 16, 16)
    mass = counts + 0.1
    share = mass / np.bincount(of, mass, 32)[of]
    assert of.max() < 32 and np.allclose(np.bincount(of, share)[np.unique(of)], 1)
    table = L.following_table(order, right, of, 32)
    assert table.shape == (40, 32) and np.allclose(np.exp(table).sum(1), 1, atol=1e-5)


def test_pair_counts_cover_all_documents(spark):
    texts = ["a b c a b", None, "", "a a", "b " * 50] * 7
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(5)
    ids_of = L.WordIds()
    ids = [L.text_ids([t], ids_of)[0] for t in texts]
    top = sorted({i for x in ids for i in x})[:4]
    row_of, slot_of = np.full(L.VOCABULARY + 1, 3), np.full(L.VOCABULARY + 1, 1)
    row_of[top[:3]], slot_of[top] = range(3), range(2, 6)
    got = L.pair_counts(df, row_of, 3, slot_of, 6, 4)
    want = np.zeros((4, 10), int)
    for x in ids:
        for t, i in enumerate(x):
            want[row_of[i], slot_of[x[t - 1]] if t else 0] += 1
            for d in (2, 4, 8):
                if t >= d and slot_of[x[t - d]] < 4:
                    want[row_of[i], 6 + slot_of[x[t - d]]] += 1
    assert (got == want).all()


def test_training_windows():
    ends = np.cumsum([1, 5, 40, 200, 7])
    starts = np.concatenate([[0], ends[:-1]])
    where, valid = L.windows(starts, ends, 8)
    assert sorted(where[valid]) == list(range(ends[-1]))  # every id once
    for at, ok in zip(where, valid):
        text = np.searchsorted(ends, at[0], "right")
        assert ok[0] and (at[ok] < ends[text]).all() and (at[ok] >= starts[text]).all()
    ids_of, rng = L.WordIds(), np.random.default_rng(3)
    texts = [" ".join(rng.choice(["river", "sky", "uncommonness", "a"], n)) for n in (0, 1, 30, 95, 400)]
    ids, before, valid = L.word_windows(texts, ids_of, 12, 50)
    assert len(ids) == 1 + 1 + 1 + 2 + 9
    whole = [L.text_ids([t], ids_of)[0].tolist() for t in texts]
    at = 0
    for t, text in enumerate(whole):
        for _ in range(-(-(len(texts[t].split()) + 1) // 50)):
            mine = ids[at][valid[at]].tolist()
            places = [i for i in range(len(text)) if text[i:i + len(mine)] == mine and (i == 0) == (before[at] < 0)
                      and (i == 0 or text[i - 1] == before[at])]
            assert places and (len(mine) == 12 or mine[-1] == L.END)
            at += 1


def test_held_out_texts_score_above_the_base(spark):
    """Learned from all training documents, the model beats the counts of single words."""
    for sf in ("sf0.01", "sf0.1"):
        rows = L.lm_scores(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).where("held_out") \
            .selectExpr("sum(score) / sum(n_tokens) s", "sum(base_score) / sum(n_tokens) b").collect()
        assert rows[0].s > rows[0].b, (sf, rows)


def test_the_model_learns_from_every_id():
    """One window after the other: no word of a training text is left out."""
    ids_of = L.WordIds()
    texts = [" ".join(f"w{i}x{k}" for k in range(n)) for i, n in enumerate((0, 1, 63, 64, 500))] + [None]
    ids, starts, _ = L.text_ids(texts, ids_of)
    slot_of = class_of = np.arange(L.VOCABULARY + 1)
    x, y, valid = L.training_windows(texts, ids_of, slot_of, class_of, 64, None)
    assert sorted(y[valid]) == sorted(ids)
    assert sorted(x[valid]) == sorted(L.inputs_of(ids, starts, slot_of))


def test_texts_are_encoded_once_before_training(spark, monkeypatch):
    """The rounds read the staged ids, every id of every text, and no text again."""
    df = spark.createDataFrame([("1", "a rare wordinesss"), ("2", None), ("3", "é b " * 40)], "doc_id string, text string")
    ids = {r.doc_id: np.frombuffer(r.ids, L.PACKED).tolist() for r in L.encoded(df).collect()}
    ids_of = L.WordIds()
    assert ids == {r.doc_id: L.text_ids([r.text], ids_of)[0].tolist() for r in df.collect()} and ids["2"] == [L.END]
    seen, refine = [], L.refine
    monkeypatch.setattr(L, "refine", lambda learn, *more: seen.append(learn.columns) or refine(learn, *more))
    docs = spark.createDataFrame([(i, f"a b c{i}") for i in range(20)], "doc_id long, text string")
    assert L.lm_scores(docs).count() == 20 and seen == [["doc_id", "ids"]]
