"""Whitening of embeddings by leading eigenvectors of their covariance, found by Jacobi-Davidson.

The covariance is never formed: every step multiplies it with a block of vectors, as one distributed pass that centres
each row exactly (n * x - S in integers) before multiplying and adds up sums of the size dimensions x block. The driver
holds vectors of the dimensions' length only, never rows. A subspace grows by the answers of correction equations
``(I - QQ')(V - theta I)(I - QQ') t = -r``, solved roughly by some steps of MINRES, all open pairs in one block, so an inner
step is one pass too. Rayleigh-Ritz in the subspace gives new pairs; those whose residual is at the level of rounding
are locked and projected out; it goes on until all are. A subspace that is full is restarted from its best vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.storage import Scratch, table

_EPS = float(np.finfo(float).eps)
#: Components count as the nearest number within these bounds, so that sums of 2**48 rows stay exact.
_LAST = 1 << 62


def _matrix(lists: pa.ListArray, dims: int, rest: int) -> np.ndarray:
    """Rows x dimensions of a batch; what a shorter vector lacks is ``rest``."""
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (n == dims).all():
        return flat.reshape(len(n), dims)
    out = np.full((len(n), dims), rest, np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: in 64-bit integers, or in unbounded ones where these would not hold it."""
    most = max(int(np.abs(x).max(initial=0)), max(map(abs, sums.tolist()), default=0) // max(n, 1)) + 1
    if 2 * most * n < 1 << 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _pieces(batches: Iterator[pa.RecordBatch], column: str, dims: int, rest: int, rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            yield part, _matrix(part.column(column), dims, rest)


class Covariance:
    """Products of the covariance of integer vectors with blocks of vectors; ``passes`` counts them."""

    def __init__(self, rows: DataFrame, column: str, rest: int):
        """``rows``: a written table; ``rest``: what a missing component counts."""
        self.rows, self.column, self.rest = rows.select(column), column, rest
        self.passes = 0
        head = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(column)), F.lit(0)).alias("d")).first()
        self.n, self.dims = head["n"], head["d"]
        self.sums = np.array(self._sums(), object)
        self.mean = np.array([s / self.n for s in self.sums.tolist()], float) if self.n else np.zeros(0)

    def _sums(self) -> list[int]:
        dims, column, rest = self.dims, self.column, self.rest

        def run(batches):
            total = [0] * dims
            for _, x in _pieces(batches, column, dims, rest):
                exact = x if int(np.abs(x).max(initial=0)) < 1 << 50 else x.astype(object)
                total = [a + int(b) for a, b in zip(total, exact.sum(axis=0), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([str(t) for t in total], pa.string())], names=["j", "s"])

        made = self.rows.mapInArrow(run, "j int, s string").groupBy("j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        found = {r["j"]: int(r["s"]) for r in made.collect()}
        return [found.get(j, 0) for j in range(dims)]

    def _pass(self, per_row: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """Sum over all rows of C' f(C), C the centred rows over n: one pass, one small table of sums."""
        n, sums, dims, column, rest = self.n, self.sums, self.dims, self.column, self.rest

        def run(batches):
            total = np.zeros(shape)
            for _, x in _pieces(batches, column, dims, rest):
                total += per_row(_centred(x, n, sums).astype(float) / n)
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["cell", "v"])

        self.passes += 1
        made = self.rows.mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros(shape[0] * shape[1])
        out[made["cell"].to_numpy()] = made["v"].to_numpy()
        return out.reshape(shape) / n

    def times(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block of vectors (dimensions x b)."""
        return self._pass(lambda c: c.T @ (c @ block), block.shape)

    def trace(self) -> float:
        return float(self._pass(lambda c: (c**2).sum(axis=0)[:, None], (self.dims, 1)).sum())

    def of_projected(self, block: np.ndarray) -> np.ndarray:
        """The covariance, centred again, of the rows projected on a block of vectors."""
        b = block.shape[1]

        def per_row(c):
            y = c @ block
            return np.vstack([y.T @ y, y.sum(axis=0)])

        got = self._pass(per_row, (b + 1, b))
        return got[:b] - np.outer(got[b], got[b])


def minres(times: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Some MINRES steps for every column of ``right`` at once: ``times`` applies each column's symmetric operator."""
    x, beta = np.zeros_like(right), np.linalg.norm(right, axis=0)
    first = beta.copy()
    v_old, v = np.zeros_like(right), right / np.where(beta > 0, beta, 1)
    d_old, d = np.zeros_like(right), np.zeros_like(right)
    c_old, c, s_old, s = (np.full(right.shape[1], z) for z in (1.0, 1.0, 0.0, 0.0))
    left, eta = np.zeros_like(beta), beta.copy()
    going = beta > 0
    for _ in range(steps):
        w = times(v)
        alpha = (v * w).sum(axis=0)
        w = w - alpha * v - left * v_old
        new = np.linalg.norm(w, axis=0)
        # two plane rotations of before, and the one that takes the new subdiagonal away
        upper, r2 = s_old * left, c * c_old * left + s * alpha
        diagonal = c * alpha - s * c_old * left
        r1 = np.hypot(diagonal, new)
        going = going & (r1 > _EPS * first)
        safe = np.where(going, r1, 1)
        c_old, s_old, c, s = c, s, np.where(going, diagonal / safe, 1), np.where(going, new / safe, 0)
        d_new = (v - r2 * d - upper * d_old) / safe
        x = x + np.where(going, c * eta, 0) * d_new
        d_old, d = d, d_new
        eta = -s * eta
        v_old, v, left = v, w / np.where(new > 0, new, 1), new
        going = going & (np.abs(eta) > tolerance * first) & (new > 0)
        if not going.any():
            break
    return x


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """The directions of ``block`` that are new beside the columns of ``against``, as orthonormal columns."""
    kept = []
    for t in block.T:
        size = np.linalg.norm(t)
        if not size > 0:
            continue
        t = t / size
        for _ in range(3):
            for q in (against, np.array(kept).T if kept else against[:, :0]):
                t = t - q @ (q.T @ t)
            size = np.linalg.norm(t)
            if size < 1e-8:
                break
            t = t / size
        else:
            kept.append(t)
    return np.array(kept).T if kept else block[:, :0]


def jacobi_davidson(times: Callable[[np.ndarray], np.ndarray], dims: int, k: int, *, scale: float, seed: int = 11, inner: int = 8, spare: int = 8, outer: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric operator, falling, and their unit eigenvectors (dimensions x k).

    ``scale`` is a bound of the largest eigenvalue (the trace). Residuals end at the level of rounding: at most
    max(16, dims) times the unit roundoff times the largest eigenvalue. The subspace holds 3 * k + spare vectors at most.
    """
    k = min(k, dims)
    room = min(dims, 3 * k + spare)
    rng = np.random.default_rng(seed)
    locked, values = np.zeros((dims, 0)), []
    space = _orthonormal(rng.standard_normal((dims, min(dims, k + spare))), locked)
    image, best, stuck = times(space), np.inf, 0
    for _ in range(outer):
        h = space.T @ image
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz, ritz_image = space @ y, image @ y
        want = min(k - len(values), space.shape[1])
        residual = ritz_image[:, :want] - ritz[:, :want] * theta[:want]
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        top = max([*values[:1], theta[0] if len(theta) else 0.0, scale * _EPS])
        level = max(16, dims) * _EPS * top
        worst = size.max(initial=0)
        best, stuck = (worst, 0) if worst < 0.5 * best else (best, stuck + 1)
        if stuck >= 4 and worst <= 100 * level:  # rounding of the products themselves: nothing is left to gain
            level = worst
        done = int(np.argmin(np.append(size <= level, False)))  # pairs are locked in order
        if done:
            locked = np.hstack([locked, ritz[:, :done]])
            values += theta[:done].tolist()
            best = np.inf
        if len(values) == k:
            break
        space, image, theta = ritz[:, done:], ritz_image[:, done:], theta[done:]
        residual, want = residual[:, done:], want - done
        if space.shape[1] + want > room - len(values):
            keep = max(want, min(space.shape[1], room - len(values) - want))
            space, image = space[:, :keep], image[:, :keep]
        near = space[:, :want]

        def project(t, q=near, fixed=locked):
            t = t - q * (q * t).sum(axis=0)
            return t - fixed @ (fixed.T @ t)

        def shifted(t, at=theta[:want], project=project):
            t = project(t)
            return project(times(t) - at * t)

        more = minres(shifted, -project(residual), inner, 1e-3)
        fresh = _orthonormal(np.hstack([project(more), residual]), np.hstack([locked, space]))[:, : max(0, dims - len(values) - space.shape[1])]
        fresh = fresh[:, : max(want, 1)]
        if fresh.shape[1] == 0:  # the subspace is everything: products anew, so that their rounding does not pile up
            image = times(space)
            continue
        space, image = np.hstack([space, fresh]), np.hstack([image, times(fresh)])
    else:
        raise RuntimeError(f"{k - len(values)} eigenpairs have not settled after {outer} rounds")
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], locked[:, order]


def quantised(df: DataFrame, row_id: str, vector: str, scale: int, shift: int) -> DataFrame:
    """``(id, x array<long>)`` of the rows whose vector is there and finite: floor(scale * c) + shift, c as double."""
    c = F.col(vector)
    fine = c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    near = lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-_LAST)), F.lit(_LAST)) + shift
    return df.where(fine).select(F.col(row_id).alias("id"), F.transform(c, near).alias("x"))


def whiten(df: DataFrame, *, row_id: str = "vec_id", vector: str = "embedding", k: int = 32, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """One row per vector: ``row_id``, ``n``, ``deviation decimal(38,0)``, ``whitened array<double>``, and, the same in
    all rows, ``explained array<double>`` and ``identity_error``.

    Vectors that are null or hold a null or non-finite component take no part; what a shorter one, an empty one too, lacks
    counts as component 0; null and repeated ids are rows like others; a component beyond 2**62 / ``scale`` counts as that.
    Components: the ``k`` leading ones whose eigenvalue is above rounding (dimensions * unit roundoff * the trace), so
    equal vectors, a single one or an empty table have none. Ties among eigenvalues give any orthonormal basis of
    their space, the same for all rows. Other columns are not looked at. ``deviation`` is null beyond 38 digits.
    """
    scratch = Scratch(df.sparkSession, "whitening")
    rows = scratch.put(quantised(df, row_id, vector, scale, shift))
    cov = Covariance(rows, "x", shift)
    trace = cov.trace() if cov.n and cov.dims else 0.0
    values, vectors = jacobi_davidson(cov.times, cov.dims, k, scale=trace) if trace > 0 else (np.zeros(0), np.zeros((cov.dims, 0)))
    real = values > max(cov.dims, 1) * _EPS * trace
    values, vectors = values[real], vectors[:, real]
    factors = vectors / np.sqrt(values)
    b = len(values)
    error = float(np.abs(cov.of_projected(factors) - np.eye(b)).max()) if b else 0.0
    n, sums, dims = cov.n, cov.sums, cov.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _pieces(batches, "x", dims, shift):
            c = _centred(x, n, sums)
            small = c.dtype != object and int(np.abs(c).max(initial=0)) ** 2 * max(dims, 1) < 1 << 62
            deviation = (c.astype(np.int64) ** 2 if small else c.astype(object) ** 2).sum(axis=1)
            deviation = [int(v) if abs(int(v)) < 10**38 else None for v in deviation]
            made = (c.astype(float) / n) @ factors
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * b, pa.int32()), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(deviation, pa.decimal128(38, 0)), lists], names=["id", "deviation", "whitened"])

    kind = rows.schema["id"].dataType.simpleString()
    told = rows.mapInArrow(run, f"id {kind}, deviation decimal(38,0), whitened array<double>")
    explained = F.array(*[F.lit(float(v / trace)) for v in values]).cast("array<double>")
    return told.select(F.col("id").alias(row_id), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op13(spark, sf_dir):
    """All ``embeddings`` whitened on 32 components, one row per vector and component; deviation is null beyond 64 bits."""
    rows = whiten(table(spark, sf_dir, "embeddings"))
    each = rows.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "x"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), F.col("x.whitened").alias("whitened"), F.col("x.explained").alias("explained"), "identity_error")
