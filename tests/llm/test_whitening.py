import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import whitening as W
from plumbline.llm.common import staged


def whitened(df, components=16):
    rows = W.integers(df)
    return W.whiten(rows, W.fit(staged(rows.select("x").distinct()), components)).collect()


def brute(rows, components):
    """vec_id and vector of valid rows: expected numbers by whole matrices and Python's integers."""
    x = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in rows]
    fit = sorted({v for _, v in x})
    n, dims = len(fit), len(fit[0])
    sums = [sum(v[d] for v in fit) for d in range(dims)]
    mean = np.array([s / n for s in sums])
    covariance = (np.array(fit, float) - mean).T @ (np.array(fit, float) - mean) / n
    value, vector = np.linalg.eigh(covariance)
    value, vector = value[::-1][:components], vector[:, ::-1].T[:components]
    return {i: (n, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)), (vector @ (np.array(v) - mean)) / np.sqrt(value), value / np.trace(covariance)) for i, v in x}


@pytest.mark.parametrize("dims", [3, 24])
def test_like_whole_matrices(spark, dims):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(400, dims)) @ rng.normal(size=(dims, dims)) + rng.normal(size=dims) * 5
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # copies, which count once
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7).withColumn("x", F.lit(1)).withColumn("a.b", F.lit(2))
    got = {}
    for r in whitened(df):
        got.setdefault(r.vec_id, {})[r.component] = r
    want = brute(rows, 16)
    assert set(got) == set(want) and all(set(g) == set(range(1, min(16, dims) + 1)) for g in got.values())
    sign = {k: np.sign(got[0][k].whitened * want[0][2][k - 1]) for k in got[0]}
    for i, (n, deviation, value, explained) in want.items():
        for k, r in got[i].items():
            assert (r.n, r.deviation) == (n, deviation)
            assert r.whitened * sign[k] == pytest.approx(value[k - 1], abs=1e-7)
            assert r.explained == pytest.approx(explained[k - 1], rel=1e-9)
            assert r.identity_error < 1e-8


def test_merged_moments_are_those_of_the_whole():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(5000, 6)) * 100) + 1_000_000
    parts = [W.Moments.of(p) for p in np.array_split(x, [1, 7, 900, 901, 4000])]
    random.Random(2).shuffle(parts)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merged(p)
    assert whole.n == 5000 and [int(s) for s in whole.sums] == x.astype(int).sum(0).tolist()
    assert np.allclose(whole.scatter, (x - x.mean(0)).T @ (x - x.mean(0)), rtol=1e-10)


def test_invalid_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.5]), (None, [3.0, 2.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, []), (8, [1.0, 1.0, 1.0]), (9, [0.0, 0.0])]
    got = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted({(r.vec_id is None, r.vec_id or 0) for r in got}) == [(False, 1), (False, 2), (False, 8), (False, 9), (True, 0)]
    assert len(got) == 4 * 2 + 3
    single = [r for r in got if r.vec_id == 8]  # the only one of its length: no variance
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in single] == [(1, 0, None, 0.0, 0.0)] * 3
    assert {r.n for r in got if r.vec_id != 8} == {4}


def test_huge_entries(spark):
    got = whitened(spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [-1e300, 2.0])], "vec_id long, embedding array<double>"))
    assert len(got) == 6 and all(r.deviation is None for r in got if r.vec_id != 2)


def test_no_rows(spark):
    assert whitened(spark.createDataFrame([], "vec_id long, embedding array<float>")) == []
    assert whitened(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")) == []
