"""Whitening against dense eigenvectors of the exact covariance."""
import math

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as E
from regiopanel.llm import whitening as W

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, n string"


def check(rows, vectors, k):
    """``vectors``: [(id, list)] of the rows that count."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in vectors], object)
    n, sums = len(x), x.sum(0)
    centred = np.array((n * x - sums) / n, float)
    cov = centred.T @ centred / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    by_id = {}
    for r in rows:
        by_id.setdefault(r.vec_id, []).append(r)
    assert len(rows) == n * k and sorted(by_id, key=str) == sorted({i for i, _ in vectors}, key=str)
    got = np.empty((n, k))
    for at, (i, _) in enumerate(vectors):
        mine = sorted(by_id[i], key=lambda r: r.component)
        assert [r.component for r in mine] == list(range(1, k + 1))
        assert {r.n for r in mine} == {n} and {r.deviation for r in mine} == {int(((n * x[at] - sums) ** 2).sum())}
        got[at] = [r.whitened for r in mine]
        assert np.allclose([r.explained for r in mine], e / np.trace(cov), rtol=1e-9)
    want = centred @ q / np.sqrt(e)
    sign = np.sign((got * want).sum(0))
    assert np.abs(got - want * sign).max() < 1e-7
    error = np.abs(np.cov(got.T, bias=True).reshape(k, k) - np.eye(k)).max()
    assert error < 1e-9 and {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9


def test_query(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    vectors = [(i, [float(np.float64(np.float32(c))) for c in v]) for i, v in zip(table["vec_id"], table["embedding"])
               if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    check(E.queries()["op13_whitening"](spark, SF).collect(), vectors, 32)


def test_wrong_rows_go_and_blocks_do_not_matter(spark):
    rng = np.random.default_rng(1)
    good = [(i, list(map(float, rng.standard_normal(6) * [9, 5, 3, 2, 1, 0.5]))) for i in range(90)]
    wrong = [(500, None), (501, []), (502, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (503, [math.nan] * 6), (504, [math.inf, 1.0, 1.0, 1.0, 1.0, 1.0]),
             (505, [1.0, 1.0, 1.0, 1.0, 1.0, -math.inf])]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + wrong + [(None, good[3][1])]], SCHEMA)
    vectors = good + [(None, good[3][1])]
    check(W.whiten(df).collect(), vectors, 6)
    check(W.whiten(df.repartition(5), components=3, block_rows=4).collect(), vectors, 3)


def test_repeated_rows_and_flat_directions(spark):
    rows = [(1, [1.0, 2.0, 5.0]), (1, [1.0, 2.0, 5.0]), (2, [3.0, 1.0, 5.0]), (3, [0.0, 0.0, 5.0])]
    got = W.whiten(spark.createDataFrame([(*r, "") for r in rows], SCHEMA)).collect()
    assert len(got) == 4 * 2  # the third dimension is flat
    assert sorted(r.component for r in got if r.vec_id == 1) == [1, 1, 2, 2]
    assert sum(r.explained for r in got if r.vec_id == 2) == pytest.approx(1)
    same = spark.createDataFrame([(1, [1.0, 2.0], ""), (2, [1.0, 2.0], "")], SCHEMA)
    assert W.whiten(same).count() == 0 and W.whiten(same.limit(1)).count() == 0 and W.whiten(same.where("false")).count() == 0


def test_lengths_must_agree(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], ""), (2, [1.0], "")], SCHEMA).coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        W.whiten(df).collect()
    with pytest.raises(ValueError, match="different lengths"):
        W.whiten(df.repartition(2, "vec_id").union(df.limit(0))).collect()


def test_solver_restarts_and_reaches_double_precision():
    rng = np.random.default_rng(3)
    for d, k, spectrum in ((150, 10, np.geomspace(50, 0.1, 150)), (120, 6, np.ones(120)), (40, 40, np.repeat([3.0, 2.0], 20))):
        q0 = np.linalg.qr(rng.standard_normal((d, d)))[0]
        a = (q0 * spectrum) @ q0.T
        values, q = W.jacobi_davidson(lambda x, a=a: a @ x, d, k, block=3, width=min(d, k + 8))
        assert np.allclose(values, np.sort(spectrum)[::-1][:k], rtol=1e-12)
        assert np.abs(a @ q - q * values).max() < 1e-11 * spectrum.max() and np.abs(q.T @ q - np.eye(k)).max() < 1e-12


def test_minres_solves_several_systems_in_step():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    b = rng.standard_normal((12, 3))
    assert np.allclose(a @ W.minres(lambda v: a @ v, b, 40), b, atol=1e-6)


def test_partial_products_meet_in_a_tree(spark):
    rng = np.random.default_rng(7)
    rows = [(i, list(map(float, rng.integers(-9, 9, 3)))) for i in range(300)]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    blocks = W.blocks_of(W.usable_rows(df.repartition(150, "vec_id"), "vec_id", "embedding"), 1)
    cov = W.Covariance(blocks.repartition(150))
    assert cov.tasks == 150
    x = np.array([[64 * c for c in v] for _, v in rows])
    assert np.allclose(cov.times(np.eye(3)), np.cov(x.T, bias=True), rtol=1e-12)
