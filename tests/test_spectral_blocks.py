"""Eigenvectors of the spectral fits: few products, and those of the whole affinity matrix."""

import numpy as np
import pytest

from pricelens.operators import spectral as sp


def _vectors(spark, n, d, names=False):
    x = np.random.default_rng(5).normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    of = (lambda i: f"city {i:04d}") if names else int
    return spark.createDataFrame([(of(i), v.tolist()) for i, v in enumerate(x)], f"entity {'string' if names else 'long'}, features array<double>"), x


def _eigenvalues(w, k):
    s = 1 / np.sqrt(w.sum(axis=1))
    return np.sort(np.linalg.eigvalsh(w * s[:, None] * s[None, :]))[::-1][:k]


def test_dense_eigenvalues_settle_in_few_products(spark):
    vec, x = _vectors(spark, 700, 32, names=True)
    w = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(w, 0)
    info = sp.spectral(vec, 4, gamma=1.0, n_init=1, block_rows=128).info
    assert info["eigenvalues"] == pytest.approx(_eigenvalues(w, 4), abs=1e-6)
    assert info["eigen_iterations"] <= 7


def test_sparse_eigenvalues_are_those_of_the_graph(spark):
    vec, x = _vectors(spark, 600, 3)
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2).argsort(axis=1, kind="stable")[:, :10]
    a = np.zeros((600, 600))
    a[np.repeat(np.arange(600), 10), near.reshape(-1)] = 1
    w = (a + a.T) / 2
    np.fill_diagonal(w, 0)
    info = sp.spectral(vec, 4, affinity="nearest_neighbors", n_init=1, block_rows=128).info
    assert info["eigenvalues"] == pytest.approx(_eigenvalues(w, 4), abs=1e-5)


def test_repeated_entities_are_rows_of_their_own(spark):
    vec, _ = _vectors(spark, 60, 4)
    twice = vec.unionAll(vec.where("entity % 6 = 0"))
    res = sp.spectral(twice, 3, gamma=1.0, n_init=2)
    assert res.labels.count() == 70 and res.labels.distinct().count() == 60
    assert res.info["eigenvalues"][0] == pytest.approx(1.0, abs=1e-9)
