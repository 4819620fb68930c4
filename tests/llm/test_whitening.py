"""Jacobi-Davidson whitening against a dense eigen-decomposition and exact integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import whitening as wh


@pytest.mark.parametrize(("dims", "k", "decay"), [(64, 32, 0), (200, 5, 0), (200, 12, 20), (3, 32, 0), (1, 1, 0)])
def test_eigenpairs_reach_double_precision(dims, k, decay):
    rng = np.random.default_rng(dims + k)
    a = rng.standard_normal((1000, dims)) * (np.exp(-np.arange(dims) / decay) if decay else 1)
    v = a.T @ a / len(a)
    e, q = wh.jacobi_davidson(lambda b: v @ b, dims, k, scale=np.trace(v))
    assert len(e) == min(k, dims) and np.allclose(e, np.linalg.eigvalsh(v)[::-1][: len(e)], rtol=0, atol=1e-13 * e[0])
    assert np.linalg.norm(v @ q - q * e, axis=0).max() <= max(16, dims) * 1e-15 * e[0] * 4
    assert np.abs(q.T @ q - np.eye(len(e))).max() < 1e-13


def test_equal_eigenvalues():
    v = np.diag([5.0] * 6 + [1.0] * 60)
    e, q = wh.jacobi_davidson(lambda b: v @ b, 66, 9, scale=np.trace(v))
    assert np.allclose(e, [5] * 6 + [1] * 3) and np.abs(v @ q - q * e).max() < 1e-12


def test_minres_solves():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((40, 40))
    a = a + a.T
    b = rng.standard_normal((40, 5))
    assert np.abs(a @ wh.minres(lambda t: a @ t, b, 200, 1e-12) - b).max() < 1e-6


def brute(rows, k):
    """vec_id, x of the rows that take part -> (deviations, whitened up to sign, explained)."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    c = np.array([[(n * a - s) / n for a, s in zip(r, sums, strict=True)] for r in x])
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return deviation, c @ q / np.sqrt(e), e / np.trace(v)


def test_query_equals_dense(spark, sf):
    data = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    deviation, white, explained = brute([r["embedding"] for r in data], 32)
    got = wh.op13(spark, sf).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 32 * len(data) and (got["n"] == len(data)).all() and (got["identity_error"] < 1e-9).all()
    assert got["deviation"].to_numpy().reshape(-1, 32)[:, 0].tolist() == deviation
    mine = got["whitened"].to_numpy().reshape(-1, 32)
    sign = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine - white * sign).max() < 1e-7
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 32)[0], explained, rtol=1e-9)


def test_odd_rows(spark):
    rng = np.random.default_rng(8)
    good = [(i, [float(x) for x in rng.standard_normal(4)]) for i in range(30)]
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [1.0, float("nan"), 2.0, 3.0]), (103, [float("inf"), 1.0, 1.0, 1.0])]
    kept = [(None, [1.0, 2.0, 3.0, 4.0]), (5, [0.5, 0.25, 0.0, 1.0]), (5, [0.5, 0.25, 0.0, 1.0]), (200, [1.0]), (201, [])]
    df = spark.createDataFrame(good + odd + kept, "vec_id long, embedding array<float>").withColumn("x", F.lit("own")).withColumn("n", F.lit(1)).withColumn("id", F.lit(2))
    full = [r[1] + [0.0] * (4 - len(r[1])) for r in good + kept]
    deviation, white, _ = brute(full, 32)
    got = sorted(wh.whiten(df).collect(), key=lambda r: (int(r["deviation"]), r["vec_id"] or -1))
    assert len(got) == 35 and [int(r["deviation"]) for r in got] == sorted(deviation) and {r["n"] for r in got} == {35}
    assert sorted(str(r["vec_id"]) for r in got) == sorted(str(r[0]) for r in good + kept)
    assert np.allclose(np.sort(np.abs([r["whitened"] for r in got]), axis=None), np.sort(np.abs(white), axis=None), atol=1e-8)


def test_large_numbers_stay_exact(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [1e9, 2.0])]
    got = wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [[min(max(math.floor(64 * c), -(1 << 62)), 1 << 62) + 1_000_000 for c in r[1]] for r in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = {r[0]: sum((3 * a - s) ** 2 for a, s in zip(y, sums, strict=True)) for r, y in zip(rows, x, strict=True)}
    assert {r["vec_id"]: None if r["deviation"] is None else int(r["deviation"]) for r in got} == {i: v if v < 10**38 else None for i, v in want.items()}


def test_no_components(spark):
    schema = "vec_id long, embedding array<float>"
    assert wh.whiten(spark.createDataFrame([], schema)).count() == 0
    got = wh.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r["whitened"], r["explained"], int(r["deviation"])) for r in got] == [([], [], 0)] * 2
