"""Whitening of embeddings by a distributed Jacobi-Davidson eigensolver.

Rows.  An entry c becomes the whole number floor(64 * c) + 1000000; as everything is
centred, the shift cancels and is left out of the arithmetic.  Rows whose vector is null,
empty, or holds a null or non-finite entry are dropped.  The others are staged once as
blocks: each row of the staged table holds up to ``block_rows`` vectors (and at most
``_BLOCK_BYTES`` bytes) as one binary matrix, so a pass over the data is a few matrix
products per task.

Moments.  Sums per dimension and the sum of squares are whole numbers: each task adds
64-bit integers over bounded blocks, the driver adds the tasks' d numbers exactly.

Covariance products.  The covariance is never formed.  A product with a d x b matrix Q
is one pass: a task centres its blocks, multiplies Xc' (Xc Q), and the d x b partial
products meet in a tree (about the square root of the number of tasks at each level),
so neither a task nor the driver receives more than that many small matrices.

Jacobi-Davidson.  The subspace starts from a fixed random block.  Rayleigh-Ritz on the
subspace gives Ritz pairs, best first; leading pairs whose residual is at most
``tolerance`` times the largest eigenvalue (a few units of rounding of a product) are
locked and projected out.  For the next pairs the projected correction equations
(I - Q Q')(A - theta I)(I - Q Q') t = -r are solved by a few MINRES steps, all of them
in step, so one step is one pass for the whole block.  The corrections, made orthogonal,
extend the subspace; when it is too wide it restarts from its best Ritz vectors.

Result.  ``whitened`` is the centred row projected on the unit eigenvector, over the
square root of the eigenvalue.  Components whose eigenvalue is zero up to rounding have
no whitening and are left out, so n equal rows, or one row, give no output.
``identity_error`` compares the covariance of the whitened rows, from one more pass,
with the identity.

Defined cases: vectors of different lengths are an error; null and repeated ids are
kept, each row for itself; an empty table gives an empty result; extra columns are
ignored; a deviation or entry that a long can't hold is an error.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, tree_sum

_BLOCK_BYTES = 8 << 20
_BLOCKS = "ids array<long>, n int, d int, data binary"


def usable_rows(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): whole-number vectors of the rows that remain, without the shift."""
    v = F.col(vector_col).cast("array<double>")
    wrong = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where((F.size("v") > 0) & ~F.exists("v", wrong))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * 64)).alias("x"))


def blocks_of(rows: DataFrame, block_rows: int) -> DataFrame:
    """The rows as staged blocks of 64-bit whole numbers."""

    def run(batches):
        for b in batches:
            d = set(b.column("x").value_lengths().to_pylist())
            if len(d) != 1:
                raise ValueError(f"vectors of different lengths: {sorted(d)}")
            d = d.pop()
            x = b.column("x").flatten().to_numpy()
            if np.abs(x).max(initial=0) > 1 << 51:
                raise ArithmeticError("an entry is too large for exact whole numbers")
            x = x.reshape(-1, d)
            ids = b.column("vec_id")
            step = max(1, min(block_rows, _BLOCK_BYTES // (8 * d)))
            for s in range(0, len(x), step):
                part = x[s:s + step]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids.slice(s, len(part)).to_pylist()], pa.list_(pa.int64())), pa.array([len(part)], pa.int32()),
                     pa.array([d], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["ids", "n", "d", "data"])

    return stage(rows.mapInArrow(run, _BLOCKS), "vector-blocks")


def _matrix(data: bytes, d: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, d)


class Covariance:
    """Products with the covariance of staged blocks, each one pass over the data."""

    def __init__(self, blocks: DataFrame):
        self.blocks, self.tasks, self.passes = blocks, blocks.rdd.getNumPartitions(), 0

        def sums(batches):
            for b in batches:
                for n, d, data in zip(b["n"], b["d"], b["data"]):
                    x = _matrix(data, d)
                    s1, s2 = x.sum(0), (x.astype(object) ** 2).sum() if np.abs(x).max() > 1 << 20 else (x * x).sum()
                    yield pd.DataFrame({"n": [n], "d": [d], "s": [s1], "q": [str(s2)]})

        partial = blocks.select("n", "d", "data").mapInPandas(sums, "n long, d int, s array<long>, q string")
        per = partial.select("n", "d", F.col("q").cast("decimal(38,0)").alias("q"), F.posexplode("s").alias("i", "s")) \
            .groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum(F.when(F.col("i") == 0, F.col("q"))).alias("q"),
                              F.sum("n").alias("n"), F.min("d").alias("d0"), F.max("d").alias("d1"))
        got = sorted(per.collect())  # one row per dimension
        if got and len({(r.d0, r.d1) for r in got}) > 1 or any(r.d0 != r.d1 for r in got):
            raise ValueError("vectors of different lengths")
        self.d, self.n = len(got), int(got[0].n) if got else 0
        self.sums = [int(r.s) for r in got]
        self.square = int(got[0].q) if got else 0
        # trace = (n * sum of squares - sum of squared sums) / n^2, from whole numbers
        self.trace = (self.n * self.square - sum(s * s for s in self.sums)) / self.n ** 2 if got else 0.0

    def centre(self):
        """A function that centres a block: (n * x - S) / n, rounded once."""
        n, sums = self.n, self.sums
        whole = np.array([s // n for s in sums], np.int64)
        rest = np.array([(s - n * int(w)) / n for s, w in zip(sums, whole)])
        return lambda x: (x - whole) - rest

    def map_blocks(self, make) -> np.ndarray | None:
        """The sum over all blocks of ``make(centred block)``."""
        centre = self.centre()

        def run(batches):
            from pyspark import TaskContext

            total = None
            for b in batches:
                for d, data in zip(b["d"], b["data"]):
                    part = make(centre(_matrix(data, d)))
                    total = part if total is None else total + part
            if total is not None:
                yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "data": [np.ascontiguousarray(total, np.float64).tobytes()]})

        self.passes += 1
        return tree_sum(self.blocks.select("d", "data").mapInPandas(run, "part long, data binary"), self.tasks)

    def times(self, q: np.ndarray) -> np.ndarray:
        """Covariance times q (d x b)."""
        return self.map_blocks(lambda x: x.T @ (x @ q)).reshape(q.shape) / self.n


def minres(apply, b: np.ndarray, steps: int) -> np.ndarray:
    """MINRES for several symmetric systems in step: column i of the result solves the
    i-th system after at most ``steps`` products; ``apply`` takes all columns at once."""
    x, v_old, w, w_old = (np.zeros_like(b) for _ in range(4))
    beta = np.linalg.norm(b, axis=0)
    live = beta > 0
    v = b / np.where(live, beta, 1)
    eta, s, s_old, c, c_old = beta.copy(), *(np.zeros(b.shape[1]) for _ in range(2)), *(np.ones(b.shape[1]) for _ in range(2))
    beta = np.zeros(b.shape[1])
    for _ in range(steps):
        if not live.any():
            break
        p = apply(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * v_old
        beta_new = np.linalg.norm(p, axis=0)
        rho0, rho2, rho3 = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        rho1 = np.hypot(rho0, beta_new)
        live = live & (rho1 > 0)
        safe = np.where(live, rho1, 1)
        c_old, s_old, c, s = c, s, rho0 / safe, beta_new / safe
        w_old, w = w, (v - rho3 * w_old - rho2 * w) / safe
        x = x + np.where(live, c * eta * w, 0)
        eta = -s * eta
        live = live & (beta_new > 1e-300)
        v_old, v, beta = v, p / np.where(beta_new > 0, beta_new, 1), beta_new
    return x


def _orthonormal(t: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Columns of t, made orthogonal to the bases and each other; what vanishes goes."""
    t = t / np.maximum(np.linalg.norm(t, axis=0), 1e-300)
    for _ in range(2):
        for q in bases:
            t = t - q @ (q.T @ t)
    u, size, _ = np.linalg.svd(t, full_matrices=False)
    t = u[:, size > 1e-10]
    for q in bases:
        t = t - q @ (q.T @ t)
    return np.linalg.qr(t)[0] if t.shape[1] else t


def jacobi_davidson(times, d: int, k: int, block: int = 8, inner: int = 6, width: int = 0, tolerance: float = 0.0,
                    rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric positive d x d operator and their unit
    vectors; ``times`` gives its product with several columns."""
    width = width or min(d, 2 * k + 4 * block)
    tolerance = tolerance or 64 * np.finfo(float).eps * math.sqrt(d)
    locked, values = np.zeros((d, 0)), []
    basis = _orthonormal(np.random.default_rng(12345).standard_normal((d, min(d, k + block))))
    product = times(basis)
    scale = 0.0
    for _ in range(rounds):
        h = basis.T @ product
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        scale = max(scale, theta[0], *values) if len(theta) else scale
        u, au = basis @ s, product @ s
        residual = au - u * theta
        if locked.shape[1]:
            residual -= locked @ (locked.T @ residual)
        small = np.linalg.norm(residual, axis=0) <= tolerance * scale
        whole = basis.shape[1] + locked.shape[1] >= d  # the subspace is everything
        ready = 0
        while ready < len(theta) and len(values) + ready < k and (small[ready] or whole):
            ready += 1
        locked = np.hstack([locked, u[:, :ready]])
        values += list(theta[:ready])
        if len(values) >= k or ready == len(theta):
            break
        basis, product, theta, residual = u[:, ready:], au[:, ready:], theta[ready:], residual[:, ready:]
        todo = np.flatnonzero(~small[ready:])[:block]
        todo = todo[todo < k - len(values) + block]
        if basis.shape[1] + block > width:
            keep = min(basis.shape[1], k - len(values) + block)
            basis, product = basis[:, :keep], product[:, :keep]
            todo = todo[todo < keep]
        q = np.hstack([locked, basis[:, todo]])
        out = lambda t, q=q: t - q @ (q.T @ t)
        shift = theta[todo]
        # (A - theta) on the complement of q, all corrections in step
        t = minres(lambda v: out(times(out(v)) - shift * v), -out(residual[:, todo]), inner)
        t = _orthonormal(out(t), locked, basis)
        if not t.shape[1]:
            t = _orthonormal(residual[:, todo], locked, basis)
        if not t.shape[1]:  # rounding is all that is left of the residuals
            locked = np.hstack([locked, basis[:, :k - len(values)]])
            values += list(theta[:k - len(values)])
            break
        basis, product = np.hstack([basis, t]), np.hstack([product, times(t)])
    else:
        raise RuntimeError("the eigensolver did not converge")
    order = np.argsort(values)[::-1][:k]
    return np.array(values)[order], locked[:, order]


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32,
           block_rows: int = 2048, **solver) -> DataFrame:
    """One row per usable row and component: vec_id, component, n, deviation, whitened,
    explained, identity_error."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    blocks = blocks_of(usable_rows(embeddings, id_col, vector_col), block_rows)
    cov = Covariance(blocks)
    none = embeddings.sparkSession.createDataFrame([], schema)
    if not cov.n or not cov.trace > 0:
        return none
    values, vectors = jacobi_davidson(cov.times, cov.d, min(components, cov.d), **solver)
    real = values > 64 * np.finfo(float).eps * cov.d * values[0]
    values, vectors = values[real], vectors[:, real]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(values))] < 0, -1, 1)
    to_white = vectors / np.sqrt(values)
    moments = cov.map_blocks(lambda x: np.vstack([(w := x @ to_white).T @ w, w.sum(0)]))
    moments = moments.reshape(len(values) + 1, -1) / cov.n
    mean = moments[-1]
    error = float(np.abs(moments[:-1] - np.outer(mean, mean) - np.eye(len(values))).max())
    n, sums, centre = cov.n, cov.sums, cov.centre()
    explained = values / cov.trace

    def run(batches):
        shift = np.array(sums, object)
        for b in batches:
            for ids, d, data in zip(b.column("ids"), b.column("d").to_pylist(), b.column("data").to_pylist()):
                x = _matrix(data, d)
                white = centre(x) @ to_white
                spread = max(float(np.abs(x).max()) * n, max(map(abs, sums)))
                if spread < 1 << 61 and (2 * spread) ** 2 * d < 1 << 62:
                    deviation = ((n * x - np.array(sums, np.int64)) ** 2).sum(1)
                else:  # Python's whole numbers
                    exact = ((x.astype(object) * n - shift) ** 2).sum(1)
                    if max(exact) >= 1 << 63:
                        raise ArithmeticError("a deviation is larger than a long")
                    deviation = exact.astype(np.int64)
                rows, k = white.shape
                row = np.repeat(np.arange(rows), k)
                yield pa.RecordBatch.from_arrays(
                    [ids.values.take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                     pa.array(np.full(rows * k, n, np.int64)), pa.array(deviation[row]), pa.array(white.ravel()),
                     pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.select("ids", "d", "data").mapInArrow(run, schema)
